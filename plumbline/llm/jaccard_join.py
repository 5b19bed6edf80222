"""N-gram Jaccard join with token-combination prefixes.

A text's tokens are its distinct five-word shingles (the whole sequence where it has fewer words). Two texts
link when the Jaccard similarity of their sets reaches 3/4; components of links are the result.

Candidates come from prefixes under one global order that puts rare tokens first. With only rare tokens a
prefix holds n - ceil(0.75 n) + 1 of them and every one is indexed alone. Frequent tokens (those with more than
a fixed share of all token occurrences, so that their number is bounded whatever the data) are dealt by hash
into classes and indexed as pairs within a class: sharing one frequent token brings nobody together. For each
class its pairs may miss one shared token, so the prefix is extended by one token for each class it meets; then
two linking sets always share a rare token or a pair. The number of classes follows the set's size, a set
indexes its pairs under the class counts of all sizes it may link with, and pairs stay few (about half a
set's size).

Equal sets are one node from the start, so copies are never paired. Sets that share a signature form a group.

* A node carries a parity sketch: one bit for each token modulo a power of two not below its size. Two sketches
  differ in no more bits than their sets differ in tokens, so a pair whose sketches differ in more than a seventh
  of both sizes cannot link and is settled without its sets. A sketch has about a 32nd of its set's bytes.
* First every set meets the group's smaller sets as pivots (in a group of at most ``SMALL`` all its sets), and
  of what the sketches leave open each node verifies its closest pair on the whole sets.
* What shares a group but no component yet is then compared by sketches, block by block, across components only;
  first the closest of each node is verified, then all that is left. Every pair that shares
  a signature is thus in one component, settled by sketches, or verified: no link is lost, and near copies are
  rarely compared twice.

Verification fetches the sets of the pairs asked for, with 32 bits of each token. How many tokens of one set fall
together in 32 bits is known and how many of two sets may is bounded by their sizes; a pair that this would turn is
decided by all 64 bits.

Postings travel packed by ranges of the hash space and are read one range at a time. A token that is not frequent
has at most a fixed share of all postings by definition, which bounds what a range can hold. Groups are cut into
chunks of ``CHUNK`` sets, and two chunks are the unit of every comparison. A node with very many partners is dealt
out with salts where its sketch or set is joined.

Defined results: null text counts as empty; without words the set is empty and links with nothing; rows that
repeat a doc_id or a text are copies of one node; rows with a null doc_id form the node of their text and take
its component; an empty table gives an empty result; extra columns are ignored. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs_by_key, bucket_edges, byte_view, hash_windows, hash_words, lower_ascii, materialise, mix, partitions, read_documents, release, small_batches, spans, word_spans
from .components import components

SHINGLE = 5
#: Counters that a task keeps for frequent tokens, and the share of all occurrences that makes a token frequent.
COUNTERS = 1 << 17
FREQUENT = 2 / COUNTERS
#: Bits of the map that lets only candidates' texts through the scan for sets (4 MiB, whatever the data).
MAP_BITS = 1 << 25
FLUSH = 1 << 19
#: In a group of at most so many sets all pairs are looked at in the first round; larger ones are cut in chunks.
SMALL = 12
CHUNK = 512
#: Bytes of postings that a range of the hash space should hold.
RANGE_BYTES = 32 << 20
#: A node with more than this share of all pairs is dealt to so many salts.
HOT_SHARE, SALTS = 1024, 32
#: How many of its closest partners a node verifies in one round after the other; None stands for all.
CLOSEST = (1, None)
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each document."""
    low = lower_ascii(data)
    starts, ends, bounds = word_spans(low, offsets)
    words = hash_words(low, starts, ends)
    grams = hash_windows(words, k)
    for i in range(len(offsets) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield hash_windows(words[a:b], b - a)
        else:
            yield np.zeros(0, _U)


def set_key(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed number."""
    return int(np.int64(np.uint64(mix(np.array([np.bitwise_xor.reduce(s) ^ _U(len(s)), np.add.reduce(mix(s + _U(1)))], _U)).sum(dtype=_U)).view(np.int64)))


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's tokens modulo a power of two of at least 64 and not below its size, as bits."""
    m = 1 << max(6, int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def _halved(rows: np.ndarray) -> np.ndarray:
    """Sketches, one in each row, folded to half as many bits."""
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


class Sketches:
    """Sketches of different lengths, as one matrix of 64-bit words for each length."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        size = np.diff(offsets) // 8
        self.words, self.row, self.plain = size, np.zeros(len(size), np.int64), {}
        for w in np.unique(size).tolist():
            at = np.flatnonzero(size == w)
            self.row[at] = np.arange(len(at))
            self.plain[w] = data[offsets[at][:, None] + np.arange(8 * w)].view(_U).reshape(len(at), w)
        self.folded = {w // 2: _halved(m) for w, m in self.plain.items() if w > 1}

    def distance(self, other: Sketches, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits sketch i[n] of this and j[n] of ``other`` differ; lengths differ by a factor of two at most."""
        out = np.zeros(len(i), np.int64)
        x, y = self.words[i], other.words[j]
        for w in np.unique(np.minimum(x, y)).tolist():
            for (one, wx), (two, wy) in (((self.plain, w), (other.plain, w)), ((self.plain, w), (other.folded, 2 * w)), ((self.folded, 2 * w), (other.plain, w))):
                at = np.flatnonzero((x == wx) & (y == wy))
                for a in range(0, len(at), step := max(1, (1 << 20) // w)):
                    k = at[a : a + step]
                    out[k] = np.bitwise_count(one[w][self.row[i[k]]] ^ two[w][other.row[j[k]]]).sum(axis=1, dtype=np.int64)
        return out


def may_link(distance: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Similarity 3/4 leaves at most a seventh of both sizes different."""
    return 7 * distance <= total


class Frequent:
    """Misra-Gries counts: every token with more than n / COUNTERS occurrences of n is kept."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, _U), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        tokens = np.sort(tokens)
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        keys = np.concatenate((self.keys, tokens[first]))
        counts = np.concatenate((self.counts, np.diff(np.append(first, len(tokens)))))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > COUNTERS:
            cut = np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
            keep = counts > cut
            keys, counts = keys[keep], counts[keep] - cut
        self.keys, self.counts = keys, counts


def _describe(batches):
    """kind 0: a = id, b = set size, c = set fingerprint, sketch; kind 1: a token of a task's counters, b its count."""
    heavy, held, n = Frequent(), [], 0
    for b in batches:
        data, offsets = byte_view(b.column(1))
        for i, j in spans(offsets):
            sets = list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            held += sets
            n += sum(map(len, sets))
            if n >= FLUSH:
                heavy.add(np.concatenate(held))
                held, n = [], 0
            size = np.array([len(s) for s in sets], np.int64)
            keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.int64)
            yield batch(kind=np.zeros(len(sets), np.int32), a=b.column(0).slice(i, j - i), b=size, c=keys, sketch=pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()))
    if held:
        heavy.add(np.concatenate(held))
    keep = heavy.counts > 1
    n = int(keep.sum())
    yield batch(kind=np.ones(n, np.int32), a=heavy.keys[keep].view(np.int64), b=heavy.counts[keep], c=np.zeros(n, np.int64), sketch=pa.nulls(n, pa.binary()))


def _tiers(n: int, num: int, den: int) -> set[int]:
    return {n.bit_length(), (-(-num * n // den)).bit_length()}


def signatures(s: np.ndarray, is_frequent: np.ndarray, num: int = 3, den: int = 4) -> tuple[np.ndarray, bool]:
    """The signatures of one set of at least two sorted tokens, and whether some are pairs; threshold num / den."""
    n = len(s)
    need = -(-num * n // den)
    rare, often = s[~is_frequent], s[is_frequent]
    p = n - need + 1
    if len(rare) >= p or not len(often):
        return rare[:p], False
    out = [rare]
    for tier in _tiers(n, num, den):
        classes = max(1, (1 << (tier - 1)) * (den - num) // den)
        cls = (mix(often ^ _U(tier)) % _U(classes)).astype(np.int64)
        fresh = np.zeros(len(cls), np.int64)
        fresh[np.unique(cls, return_index=True)[1]] = 1
        met = np.cumsum(fresh)
        f = np.arange(1, len(often) + 1)
        enough = np.flatnonzero(len(rare) + f - n + need >= 1 + met)
        f = int(enough[0]) + 1 if len(enough) else len(often)
        order = np.argsort(cls[:f], kind="stable")
        c, t = cls[:f][order], often[:f][order]
        step = 1
        while step < f:
            same = np.flatnonzero(c[step:] == c[:-step])
            if not len(same):
                break
            out.append(mix(t[same] * _U(0x9E3779B97F4A7C15) + t[same + step] * _U(0xC2B2AE3D27D4EB4F) + _U(tier)))
            step += 1
    return np.unique(np.concatenate(out)), True


def _postings(frequent: np.ndarray, buckets: int):
    """Packed postings: for each range of the hash space signatures, set fingerprints and sizes."""

    def flush(sig, key, size):
        sig, key, size = np.concatenate(sig), np.concatenate(key), np.concatenate(size)
        order = np.argsort(sig)
        sig, key, size = sig[order], key[order], size[order]
        edges = bucket_edges(sig, buckets)
        rows = [(k, edges[k], edges[k + 1]) for k in range(buckets) if edges[k + 1] > edges[k]]
        blobs = [sig[a:b].tobytes() + key[a:b].tobytes() + size[a:b].tobytes() for _, a, b in rows]
        return batch(bucket=np.array([r[0] for r in rows], np.int32), blob=pa.array(blobs, pa.binary()))

    def run(batches):
        sig, key, size, held = [], [], [], 0
        for b in batches:
            data, offsets = byte_view(b.column(1))
            for i, j in spans(offsets):
                seen = set()
                for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    if len(s) < 2 or (k := set_key(s)) in seen:
                        continue
                    seen.add(k)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        out, _ = signatures(s, frequent[at] == s)
                    else:
                        out = s[: len(s) - (3 * len(s) + 3) // 4 + 1]
                    sig.append(out)
                    key.append(np.full(len(out), k, np.int64))
                    size.append(np.full(len(out), len(s), np.uint32))
                    held += len(out)
                if held >= FLUSH:
                    yield flush(sig, key, size)
                    sig, key, size, held = [], [], [], 0
        if held:
            yield flush(sig, key, size)

    return run


def _groups(batches):
    """The distinct groups of two or more sets that share a signature, in chunks of sets sorted by size."""
    for _, blobs in blobs_by_key(batches):
        parts = [(np.frombuffer(x, _U, n := len(x) // 20), np.frombuffer(x, np.int64, n, 8 * n), np.frombuffer(x, np.uint32, n, 16 * n)) for x in blobs]
        sig, key, size = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((key, size, sig))
        sig, key, size = sig[order], key[order], size[order]
        keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        sig, key, size = sig[keep], key[keep], size[keep]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        runs = np.diff(np.append(first, len(sig)))
        seen: set[int] = set()
        rows = []
        for a, n in zip(first[runs > 1].tolist(), runs[runs > 1].tolist(), strict=True):
            gid = set_key(np.sort(key[a : a + n].view(_U)))
            if gid not in seen:
                seen.add(gid)
                rows += [(gid, n, k, key[at : min(at + CHUNK, a + n)], size[at : min(at + CHUNK, a + n)]) for k, at in enumerate(range(a, a + n, CHUNK))]
        for at in range(0, len(rows), 1024):
            gid, n, chunk, keys, sizes = zip(*rows[at : at + 1024], strict=True)
            yield batch(gid=np.array(gid, np.int64), members=np.array(n, np.int64), chunk=np.array(chunk, np.int32), keys=pa.array(keys, pa.list_(pa.int64())), sizes=pa.array([x.astype(np.int64) for x in sizes], pa.list_(pa.int64())))


def _pivot_pairs(batches):
    """All pairs of a small group; in a chunk of a larger one each set with the smallest set that it may link with."""
    for b in batches:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for members, keys, sizes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            k, n = keys.values.to_numpy(), sizes.values.to_numpy()
            if members <= SMALL:
                i, j = np.triu_indices(len(k), 1)
            else:
                i, j, at = [], [], 0
                while at < len(k):
                    end = int(np.searchsorted(n, n[at] * 4 // 3, "right"))
                    i.append(np.full(max(0, end - at - 1), at))
                    j.append(np.arange(at + 1, end))
                    at = max(end, at + 1)
                i, j = np.concatenate(i), np.concatenate(j)
            ok = 4 * n[i] >= 3 * n[j]
            found.append((np.minimum(k[i[ok]], k[j[ok]]), np.maximum(k[i[ok]], k[j[ok]])))
        x, y = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
        yield batch(a=x[first], b=y[first])


def _hot(pairs: DataFrame) -> dict[str, list[int]]:
    """For each end the nodes with more than a fixed share of all pairs: at most HOT_SHARE."""
    total = pairs.count()
    least = max(4096, total // HOT_SHARE)
    if total <= least:
        return {"a": [], "b": []}
    return {end: [r[0] for r in pairs.groupBy(end).count().where(F.col("count") > least).select(end).collect()] for end in ("a", "b")}


def _attach(pairs: DataFrame, end: str, table: DataFrame, hot: list[int]) -> DataFrame:
    """``pairs`` with the columns of ``table`` for the node in ``end``; hot nodes are dealt out by the other end."""
    table = table.withColumnRenamed("key", end)
    if not hot:
        return pairs.join(table, end)
    is_hot = F.col(end).isin(hot)
    salted = pairs.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("a", "b"), F.lit(SALTS))).otherwise(0).cast("int"))
    table = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(table, [end, "_salt"]).drop("_salt")


def _near(batches):
    """(a, b, apart) of the pairs that sketches leave open; ``apart`` is their distance as a share of both sizes."""
    for b in batches:
        if not b.num_rows:
            continue
        a, other, x, y, u, v = b.columns
        total = x.to_numpy() + y.to_numpy()
        i = np.arange(len(total))
        distance = Sketches(u).distance(Sketches(v), i, i)
        ok = may_link(distance, total)
        yield batch(a=a.filter(pa.array(ok)), b=other.filter(pa.array(ok)), apart=distance[ok] / total[ok])


def _open_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, apart) of what may link."""
    known, hot = nodes.select("key", "n", "sketch"), _hot(pairs)
    with_a = _attach(pairs, "a", known.withColumnsRenamed({"n": "x", "sketch": "u"}), hot["a"])
    both = _attach(with_a, "b", known.withColumnsRenamed({"n": "y", "sketch": "v"}), hot["b"])
    return both.select("a", "b", "x", "y", "u", "v").mapInArrow(_near, "a long, b long, apart double")


def _units(batches):
    """The rows of one unit after the other, as a batch each; rows come sorted by unit."""
    held = []
    for b in batches:
        unit = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for lo, hi in pairwise(cuts):
            if hi > lo:
                if held and held[0].column(0)[0].as_py() != unit[lo]:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compare(closest: int | None):
    """Within a chunk (side 0 only) or across two chunks: pairs of different components that may link.

    With ``closest`` only so many of the nearest are given for each set.
    """

    def run(batches):
        for u in _units(batches):
            side, key, n, comp = (u.column(c).to_numpy() for c in (1, 2, 3, 4))
            marks = Sketches(u.column(5))
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = not len(y)
            if within:
                y = x
            # The commonest component is not compared with itself.
            names, times = np.unique(comp[np.concatenate((x, y))], return_counts=True)
            most = names[np.argmax(times)]
            found = []
            for rows, cols, triangle in ((x[comp[x] != most], y, False), (x[comp[x] == most], y[comp[y] != most], within)):
                if triangle:  # met from the other side
                    continue
                for at in range(0, len(rows), 256):
                    r = rows[at : at + 256]
                    ok = (comp[r][:, None] != comp[cols]) & (4 * n[r][:, None] >= 3 * n[cols]) & (3 * n[r][:, None] <= 4 * n[cols])
                    p, q = np.nonzero(ok)
                    p, q = r[p], cols[q]
                    distance = marks.distance(marks, p, q)
                    near = may_link(distance, n[p] + n[q])
                    found.append((p[near], q[near], distance[near] / (n[p] + n[q])[near]))
            p, q, apart = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            if closest is not None and len(p):
                keep = np.zeros(len(p), bool)
                for end in (p, q):
                    order = np.lexsort((apart, end))
                    first = np.concatenate(([True], end[order][1:] != end[order][:-1]))
                    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                    keep[order[rank < closest]] = True
                p, q, apart = p[keep], q[keep], apart[keep]
            yield batch(a=np.minimum(key[p], key[q]), b=np.maximum(key[p], key[q]), apart=np.asarray(apart, np.float64))

    return run


def _sets_of(bitmap: np.ndarray, bits: int):
    """(key, n, tokens) of the texts that the map lets through; distinct upper ``bits`` of the tokens."""
    kind, arrow = (np.int32, pa.int32()) if bits == 32 else (np.int64, pa.int64())

    def run(batches):
        for b in batches:
            h = b.column(2).to_numpy()
            mine = np.flatnonzero(bitmap[h >> 3] >> (h & 7).astype(np.uint8) & 1)
            if len(mine):
                part = b.take(pa.array(mine))
                data, offsets = byte_view(part.column(1))
                for i, j in spans(offsets):
                    keep = [s for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) if len(s)]
                    if keep:
                        tokens = [np.unique((s >> _U(64 - bits)).astype(np.uint32 if bits == 32 else _U)).view(kind) for s in keep]
                        yield batch(key=np.array([set_key(s) for s in keep], np.int64), n=np.array([len(s) for s in keep], np.int64), tokens=pa.array(tokens, pa.list_(arrow)))

    return run


class _Linker:
    """Fetches the sets of candidate pairs and verifies them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes

    def _sets(self, pairs: DataFrame, bits: int) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        ids = ends.join(self.nodes, "key").select((F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS)) + 1).alias("h"))
        rows = ids.select(F.bitmap_bucket_number("h").alias("k"), F.bitmap_bit_position("h").alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()
        bitmap = np.zeros(MAP_BITS // 8, np.uint8)
        for r in rows:  # at most MAP_BITS / 32,768 rows of 4 KiB
            bitmap[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        texts = self.docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("h"))
        sets = texts.mapInArrow(_sets_of(bitmap, bits), f"key long, n long, tokens array<{'int' if bits == 32 else 'long'}>")
        return materialise(sets.join(ends, "key", "left_semi"), "op9-sets")

    def _common(self, pairs: DataFrame, bits: int) -> tuple[DataFrame, str]:
        """(a, b, na, nb, lost, common): sizes, how many tokens fell together at most, and how many are shared."""
        sets, hot = self._sets(pairs, bits), _hot(pairs)
        with_a = _attach(pairs, "a", sets.withColumnsRenamed({"n": "na", "tokens": "x"}), hot["a"])
        both = _attach(with_a, "b", sets.withColumnsRenamed({"n": "nb", "tokens": "y"}), hot["b"])
        lost = F.least(F.col("na") - F.size("x"), F.col("nb") - F.size("y"))
        return both.select("a", "b", "na", "nb", lost.alias("lost"), F.size(F.array_intersect("x", "y")).alias("common")), sets.scratch

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` that link, as a scratch table."""
        spark = pairs.sparkSession
        links = lambda common: 4 * common >= 3 * (F.col("na") + F.col("nb") - common)
        common, sets = self._common(pairs, 32)
        first = materialise(common, "op9-common")
        release(spark, sets)
        # Tokens of one set that fall together are counted; those of two sets number this many or more once in 10**16 pairs.
        expected = F.col("na") * F.col("nb") / float(1 << 32)
        between = F.ceil(4 + 12 * F.sqrt(expected) + 2 * expected)
        sure, open_ = links(F.col("common") - between), links(F.col("common") + F.col("lost"))
        out, odd = first.where(sure).select("a", "b"), first.where(open_ & ~sure).select("a", "b")
        gone = [first.scratch]
        if not odd.isEmpty():
            common, sets = self._common(odd, 64)
            out = out.union(common.where(links(F.col("common"))).select("a", "b"))
            gone.append(sets)
        out = materialise(out.distinct(), "op9-links")
        release(spark, *gone)
        return out


def _labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the component of the node in ``key``; a node without links is its own."""
    labels = labels.select(F.col("node").alias(key), F.col("component").alias(name))
    return rows.join(labels, key, "left").withColumn(name, F.coalesce(name, key))


def _mixed_units(groups: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (gid, chunk, key, component) of groups with several components, and the pairs of chunks to compare."""
    large = groups.where(F.col("members") > SMALL).select("gid", "chunk", F.explode(F.arrays_zip("keys", "sizes")).alias("m"))
    members = materialise(_labelled(large.select("gid", "chunk", F.col("m.keys").alias("key"), F.col("m.sizes").alias("n")), labels, "key", "component"), "op9-members")
    chunks = members.groupBy("gid", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    x, y = chunks.alias("x"), chunks.alias("y")
    units = x.join(y, F.expr("x.gid = y.gid AND x.chunk <= y.chunk AND 3 * y.least <= 4 * x.most AND 3 * x.least <= 4 * y.most AND (x.lo <> x.hi OR y.lo <> y.hi OR x.lo <> y.lo)"))
    units = units.select("x.gid", F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j")).withColumn("unit", F.xxhash64("gid", "i", "j"))
    return members, units


def _across(groups: DataFrame, nodes: DataFrame, labels: DataFrame, closest: int | None) -> DataFrame:
    """(a, b, apart) of large groups' pairs that are in different components and may link, as a scratch table."""
    spark = groups.sparkSession
    members, units = _mixed_units(groups, labels)
    units = materialise(units, "op9-units")
    sides = units.select("unit", "gid", F.col("i").alias("chunk"), F.lit(0).alias("side")).union(units.where("i < j").select("unit", "gid", F.col("j"), F.lit(1)))
    rows = members.join(sides, ["gid", "chunk"]).join(nodes.select("key", "sketch"), "key")
    rows = rows.select("unit", "side", "key", "n", "component", "sketch").repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    out = materialise(rows.mapInArrow(_compare(closest), "a long, b long, apart double").groupBy("a", "b").agg(F.first("apart").alias("apart")), "op9-across")
    release(spark, members.scratch, units.scratch)
    return out


def _closest_of_each(pairs: DataFrame) -> DataFrame:
    """For each node the closest of the pairs in which it is the larger key."""
    return pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the components of links at similarity 0.75."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = materialise(docs.mapInArrow(_describe, "kind int, a long, b long, c long, sketch binary"), "op9-seen")
    total = seen.where("kind = 0").agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    heavy = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") > max(8, total * FREQUENT))
    frequent = np.sort(np.array([r["a"] for r in heavy.select("a").collect()], np.int64).view(_U))  # at most COUNTERS / 2 tokens
    per_doc = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.when(F.col("b") > 0, F.col("c")).alias("key"), "sketch")
    nodes = materialise(per_doc.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "op9-nodes")
    per_doc = per_doc.drop("sketch")

    parts = partitions(spark)
    ranges = max(4 * parts, int(total * 5 / RANGE_BYTES))  # a quarter of the tokens, 20 bytes each
    packed = docs.where("text IS NOT NULL").mapInArrow(_postings(frequent, ranges), "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    groups = packed.mapInArrow(_groups, "gid long, members long, chunk int, keys array<long>, sizes array<long>")
    groups = groups.groupBy("gid", "chunk").agg(*(F.first(c).alias(c) for c in ("members", "keys", "sizes")))
    groups = materialise(groups, "op9-groups")
    release(spark)

    linker = _Linker(docs, nodes)
    pairs = materialise(groups.select("members", "keys", "sizes").mapInArrow(_pivot_pairs, "a long, b long").distinct(), "op9-pairs")
    near = materialise(_open_pairs(pairs, nodes), "op9-near")
    release(spark, pairs.scratch)
    done = materialise(_closest_of_each(near), "op9-asked")
    tables = [done.scratch]
    links = linker.verify(done)
    tables.append(links.scratch)
    labels = materialise(components(links, label="op9-cc"), "op9-labels")
    for closest in CLOSEST:
        across = _across(groups, nodes, labels, closest)
        rest = _labelled(_labelled(near, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b", "apart")
        rest = across.union(rest).join(done, ["a", "b"], "left_anti")
        rest = materialise(_closest_of_each(rest) if closest == 1 else rest.select("a", "b").distinct(), "op9-rest")
        over = across.isEmpty()
        release(spark, across.scratch)
        if rest.isEmpty():
            release(spark, rest.scratch)
            if over:
                break
            continue
        found = linker.verify(rest)
        tables += [rest.scratch, found.scratch]
        done = done.union(rest)
        old = labels.scratch
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = materialise(components(known.union(found), label="op9-cc"), "op9-labels")
        release(spark, old)
    release(spark, groups.scratch, near.scratch, *tables)

    named = nodes.join(labels.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    out = per_doc.join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_components(read_documents(spark, sf_dir))
