"""LM scoring by context-tree weighting over binary-decomposed bytes, beside a word-unigram base.

A byte is eight binary decisions, each made in the context of the bits before it and of the last 0..``DEPTH``
bytes. Every (context, bits so far) is a node with counts of zeros and ones; its Krichevsky-Trofimov estimate is
mixed with what the longer contexts say: Pw = 1/2 Pe + 1/2 product of the longer contexts' Pw, at the greatest
depth Pw = Pe. After training the weights are fixed, and a bit's probability is the mixture over all depths, the
weight of each depth being its posterior. A context that was never met says 1/2. The code length of a text is
minus the sum of the logarithms; ``score`` is that sum to base 10.

Training counts cover all training texts, and the tree has all its levels whatever its size: it is never in one
place. Texts are packed in blocks; each block sends its distinct byte strings of DEPTH + 1 bytes with their
training counts, dealt by the two most recent context bytes, so that every subtree from depth 2 on is built in one
place. Depths 0 and 1 have at most 65,536 nodes, which are summed and sent back. The subtrees then answer each
block's strings with their logarithms, and the block adds them up for its documents.

The base: words of every text are dealt by hash with the documents they are in; what comes back is a partial
sum for each document, so no vocabulary is ever in one place.

Defined results: null text counts as empty, which is one end token and a score of 0 bytes; rows that repeat a
doc_id are copies and are scored each; rows without an id are trained on and scored by their text; without training texts every token is unknown and every bit
1/2; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, batch, bucket_edges, byte_view, hash_words, lower_ascii, materialise, mix, pack_sorted, partitions, read_documents, release, spans, unpack_sorted, word_spans
from .language_id import held_out_of

DEPTH = 4
#: Bytes of text in a block, and the ranges that contexts of two bytes are dealt to.
BLOCK = 1 << 23
BUCKETS = 256
FLUSH = 1 << 21
_U = np.uint64
#: Stands for the end of a text among the word hashes.
_END = _U(0x5D2F8C1B9E374A60)
_LOGS = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4097) - 0.5))))
_FACTS = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 8193)))))


def _log_half(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n - 1/2)."""
    small = n <= 4096
    x = np.where(small, 5000.0, n.astype(np.float64) + 0.5)
    stirling = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * math.log(math.pi)
    return np.where(small, _LOGS[np.where(small, n, 0)], stirling)


def _log_fact(n: np.ndarray) -> np.ndarray:
    small = n <= 8192
    x = np.where(small, 9000.0, n.astype(np.float64) + 1)
    stirling = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(small, _FACTS[np.where(small, n, 0)], stirling)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_half(zeros) + _log_half(ones) - _log_fact(zeros + ones)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its context and itself as one number, most recent context byte first and the byte last; its document."""
    n = len(data)
    length = np.diff(offsets)
    doc = np.repeat(np.arange(len(length)), length)
    pos = np.arange(n) - np.repeat(offsets[:-1], length)
    code = data.astype(_U)
    for k in range(1, DEPTH + 1):  # before a text's start there are zero bytes
        back = np.zeros(n, _U)
        back[k:] = data[: n - k]
        back[pos < k] = 0
        code |= back << _U(8 * (DEPTH + 1 - k))
    return code, doc


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def block_grams(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct grams, sorted, with training counts; their order by bucket, and each bucket's bounds in it."""
    parts = [(np.zeros(0, _U), np.zeros(0, np.int64))]
    for b in batches:
        learn = ~np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
        data, offsets = byte_view(b.column(2))
        for i, j in spans(offsets):
            codes, doc = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keys = tally(codes)[0]
            learned, times = tally(codes[learn[i:j][doc]])
            counts = np.zeros(len(keys), np.int64)
            counts[np.searchsorted(keys, learned)] = times
            parts.append((keys, counts))
            if len(parts) == 8:
                parts = [_add(parts)]
    keys, counts = _add(parts)
    bucket = (mix(keys >> _U(8 * (DEPTH - 1))) % _U(BUCKETS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return keys, counts, order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


def _blocks(batches):
    """(block, bucket, body, counts): bucket -1 is a block's rows as an Arrow stream, the others its grams and training counts."""

    def flush(held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for part in held:
                out.write_batch(part)
        keys, counts, order, edges = block_grams(held)
        rows = [(k, order[a:b]) for k, (a, b) in enumerate(pairwise(edges.tolist())) if b > a]
        body = [sink.getvalue().to_pybytes(), *(pack_sorted(keys[at]) for _, at in rows)]
        learned = [None, *(counts[at].astype(np.uint32).tobytes() if counts[at].any() else None for _, at in rows)]
        block = np.full(len(body), uuid.uuid4().int >> 65, np.int64)
        return batch(block=block, bucket=np.array([-1, *(k for k, _ in rows)], np.int32), body=pa.array(body, pa.binary()), counts=pa.array(learned, pa.binary()))

    held, size = [], 0
    for b in batches:
        offsets = byte_view(b.column(2))[1]
        for i, j in spans(offsets, BLOCK):
            if held and size + offsets[j] - offsets[i] > BLOCK:
                yield flush(held)
                held, size = [], 0
            held.append(b.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
    if held:
        yield flush(held)


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(c[k].as_py() for c in b.columns)


def node_counts(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth, sorted: key = context << 8 | bits so far with a leading one; counts of zeros and ones."""
    drop = _U(8 * (DEPTH - depth))
    ctx = keys >> _U(8) >> drop
    sym = keys & _U(255)
    ks, cs, bs = [], [], []
    for level in range(8):
        prefix = (_U(1) << _U(level)) | (sym >> _U(8 - level))
        ks.append((ctx << _U(8)) | prefix)
        bs.append((sym >> _U(7 - level)) & _U(1))
        cs.append(counts)
    key, bit, n = np.concatenate(ks), np.concatenate(bs).astype(bool), np.concatenate(cs)
    order = np.argsort(key, kind="stable")
    key, bit, n = key[order], bit[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, n, n
    return key[first], np.add.reduceat(np.where(bit, 0, n), first), np.add.reduceat(np.where(bit, n, 0), first)


def weigh(keys: np.ndarray, counts: np.ndarray, top: int, deepest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For depths top..deepest: node key, probability of a one, posterior weight of the node's own estimate, log Pw, zeros, ones."""
    out, below = [], None
    for depth in range(deepest, top - 1, -1):
        key, zeros, ones = node_counts(keys, counts, depth)
        own = log_kt(zeros, ones)
        if below is None:
            total, beta = own, np.ones(len(key))
        else:
            parent = ((below[0] >> _U(16)) << _U(8)) | (below[0] & _U(255))
            longer = np.bincount(np.searchsorted(key, parent), weights=below[3], minlength=len(key))
            total = np.logaddexp(own, longer) - math.log(2)
            beta = np.exp(own - math.log(2) - total)
        below = (key, (ones + 0.5) / (zeros + ones + 1.0), beta, total, zeros, ones)
        out.append(below)
    return out[::-1]


def _merge(batches):
    """From (bucket, body, counts) sorted by bucket: a row with all training counts of each bucket, and at bucket -1 what depth 1 needs."""
    longer, zeros, ones = np.zeros(1 << 16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for bucket, rows in groupby(_rows(batches), itemgetter(0)):
        parts = []
        for _, body, counts in rows:
            parts.append((unpack_sorted(body), np.frombuffer(counts, np.uint32).astype(np.int64)))
            if len(parts) == 16:
                parts = [_add(parts)]
        keys, counts = _add(parts)
        keys, counts = keys[counts > 0], counts[counts > 0]
        node, _, _, total, z, o = weigh(keys, counts, 2, DEPTH)[0]
        at = (((node >> _U(16)) << _U(8)) | (node & _U(255))).astype(np.int64)
        np.add.at(longer, at, total)
        np.add.at(zeros, at, z)
        np.add.at(ones, at, o)
        yield batch(bucket=np.array([bucket], np.int32), body=pa.array([pack_sorted(keys)], pa.binary()), counts=pa.array([counts.tobytes()], pa.binary()))
    at = np.flatnonzero(zeros + ones)
    if len(at):
        yield batch(bucket=np.array([-1], np.int32), body=pa.array([at.tobytes()], pa.binary()), counts=pa.array([longer[at].tobytes() + zeros[at].tobytes() + ones[at].tobytes()], pa.binary()))


def _top(rows) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Depths 0 and 1 of the tree from what each task has summed: at most 255 and 65,280 nodes."""
    longer, zeros, ones = np.zeros(1 << 16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for r in rows:
        at, blob = np.frombuffer(r["body"], np.int64), bytes(r["counts"])
        n = len(at)
        longer[at] += np.frombuffer(blob, np.float64, n)
        zeros[at] += np.frombuffer(blob, np.int64, n, 8 * n)
        ones[at] += np.frombuffer(blob, np.int64, n, 16 * n)
    out = []
    for _ in range(2):
        node = np.flatnonzero(zeros + ones)
        z, o = zeros[node], ones[node]
        own = log_kt(z, o)
        total = np.logaddexp(own, longer[node]) - math.log(2)
        out.append((node.astype(_U), (o + 0.5) / (z + o + 1.0), np.exp(own - math.log(2) - total)))
        longer, zeros, ones = np.bincount(node & 255, total, 256), np.zeros(256, np.int64), np.zeros(256, np.int64)
        np.add.at(zeros, node & 255, z)
        np.add.at(ones, node & 255, o)
    return out[::-1]


def _answer(shared):
    """From (bucket, block, body, counts) sorted by bucket and block, training counts first: the logarithms of each block's grams."""

    def run(batches):
        empty = (np.zeros(0, _U), np.zeros(0), np.zeros(0))
        for bucket, rows in groupby(_rows(batches), itemgetter(0)):
            tree = ContextTree([*shared.value, *[empty] * (DEPTH - 1)])
            for _, block, body, counts in rows:
                if block < 0:
                    tree = ContextTree([*shared.value, *(x[:3] for x in weigh(unpack_sorted(body), np.frombuffer(counts, np.int64), 2, DEPTH))])
                else:
                    yield batch(block=np.array([block], np.int64), bucket=np.array([bucket], np.int32), body=pa.array([tree.log_probs(unpack_sorted(body)).astype(np.float32).tobytes()], pa.binary()))

    return run


class ContextTree:
    """The trained tree: for each depth sorted node keys, probability of a one, weight of the node's own estimate."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels
        self.known, self.value = np.zeros(0, _U), np.zeros(0, np.float64)

    def __getstate__(self):
        return {"levels": self.levels, "known": np.zeros(0, _U), "value": np.zeros(0, np.float64)}

    def _log_probs(self, codes: np.ndarray) -> np.ndarray:
        out, sym = np.zeros(len(codes)), codes & _U(255)
        for level in range(8):
            prefix = (_U(1) << _U(level)) | (sym >> _U(8 - level))
            p = np.full(len(codes), 0.5)
            for depth in range(len(self.levels) - 1, -1, -1):
                keys, one, beta = self.levels[depth]
                if not len(keys):
                    continue
                key = ((codes >> _U(8) >> _U(8 * (DEPTH - depth))) << _U(8)) | prefix
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                p = np.where(hit, beta[at] * one[at] + (1 - beta[at]) * p, 0.5)
            out += np.log10(np.where((sym >> _U(7 - level)) & _U(1), p, 1 - p))
        return out

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability, for sorted distinct grams; what was asked before is looked up."""
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            new = self.known[at] != codes
        else:
            at, new = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
        out = self.value[at] if len(self.known) else np.zeros(len(codes))
        if new.any():
            out[new] = self._log_probs(codes[new])
            if len(self.known) > 2_000_000:
                self.known, self.value = np.zeros(0, _U), np.zeros(0)
            known = np.concatenate((self.known, codes[new]))
            value = np.concatenate((self.value, out[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.value = known[order], value[order]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of each text's probability."""
        codes, doc = grams(data, offsets)
        keys = np.sort((codes << _U(24)) | doc.astype(_U))  # 5 bytes of gram, up to 2**24 texts
        codes, doc = keys >> _U(24), (keys & _U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        value = np.repeat(self.log_probs(codes[first]), np.diff(np.append(first, len(codes))))
        return np.bincount(doc, weights=value, minlength=len(offsets) - 1)


# ---------------------------------------------------------------- word-unigram base


def _word_postings(buckets: int):
    """(bucket, blob): by word hash, the distinct words of a block with training count and, for each, documents and times."""

    def flush(held):
        word, row, train_ = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(word, kind="stable")
        word, row, train_ = word[order], row[order], train_[order]
        edges = bucket_edges(word, buckets)
        rows, blobs = [], []
        for k, (a, b) in enumerate(pairwise(edges.tolist())):
            if b > a:
                w, r, t = word[a:b], row[a:b], train_[a:b]
                at = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (r[1:] != r[:-1]))))
                times = np.diff(np.append(at, len(w))).astype(np.uint32)
                w, r, t = w[at], r[at], t[at]
                u = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                n_of = np.diff(np.append(u, len(w))).astype(np.uint32)
                count = np.add.reduceat(np.where(t, times, 0).astype(np.int64), u)
                docs, inv = np.unique(r, return_inverse=True)
                rows.append(k)
                blobs.append((pack_sorted(w[u]) + count.astype(np.uint32).tobytes() + n_of.tobytes(), docs.tobytes(), inv.astype(np.uint32).tobytes() + times.tobytes()))
        return batch(bucket=np.array(rows, np.int32), words=pa.array([x[0] for x in blobs], pa.binary()), docs=pa.array([x[1] for x in blobs], pa.binary()), uses=pa.array([x[2] for x in blobs], pa.binary()))

    def run(batches):
        held, n = [], 0
        for b in batches:
            ids, learn = b.column(0).to_numpy(), np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            data, offsets = byte_view(b.column(1))
            for i, j in spans(offsets):
                low = lower_ascii(data[offsets[i] : offsets[j]])
                starts, ends, bounds = word_spans(low, offsets[i : j + 1] - offsets[i])
                count = np.diff(bounds)
                word = np.concatenate((hash_words(low, starts, ends), np.full(j - i, _END)))
                row = np.concatenate((np.repeat(ids[i:j], count), ids[i:j]))
                held.append((word, row, np.concatenate((np.repeat(learn[i:j], count), learn[i:j]))))
                n += len(word)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _word_sums(groups: int):
    """Of one range of words: kind 0, its training tokens and distinct words; kind 1, partial sums for a group of documents."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, w, d, u in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                held.setdefault(k, []).append((w.as_py(), d.as_py(), u.as_py()))
        ids, sums, known = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        while held:
            _, blobs = held.popitem()
            words, counts, shape = [], [], []
            for w, _, _ in blobs:
                n = len(w) // 16
                words.append(unpack_sorted(w[: 8 * n]))
                counts.append(np.frombuffer(w, np.uint32, n, 8 * n).astype(np.int64))
                shape.append(np.frombuffer(w, np.uint32, n, 12 * n))
            u, c = _add(list(zip(words, counts, strict=True)))
            yield batch(kind=np.zeros(1, np.int32), part=np.zeros(1, np.int32), n=c.sum(keepdims=True), v=np.array([(c > 0).sum()], np.int64), blob=pa.array([b""], pa.binary()))
            for w, n_of, (_, d, x) in zip(words, shape, blobs, strict=True):
                mine = c[np.searchsorted(u, w)]
                docs, m = np.frombuffer(d, np.int64), len(x) // 8
                at, times = np.frombuffer(x, np.uint32, m), np.frombuffer(x, np.uint32, m, 4 * m).astype(np.float64)
                ids.append(docs)
                sums.append(np.bincount(at, times * np.repeat(np.log10(mine + 0.5), n_of), len(docs)))
                known.append(np.bincount(at, times * np.repeat(mine > 0, n_of), len(docs)))
        # One partial sum for each document that the task met, whatever number of ranges it was met in.
        row, inv = np.unique(np.concatenate(ids), return_inverse=True)
        sums, known = (np.bincount(inv, np.concatenate(x), len(row)) for x in (sums, known))
        part = (row % groups).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(groups + 1))
        out = [(g, order[a:b]) for g, (a, b) in enumerate(pairwise(edges.tolist())) if b > a]
        base = np.array([row[o].min() for _, o in out], np.int64)
        wide = np.array([int(row[o].max()) - int(row[o].min()) >= 1 << 32 for _, o in out], np.int64)
        blob = [(row[o].tobytes() if w else (row[o] - b).astype(np.uint32).tobytes()) + sums[o].tobytes() + known[o].astype(np.uint32).tobytes() for (_, o), b, w in zip(out, base, wide, strict=True)]
        yield batch(kind=np.ones(len(out), np.int32), part=np.array([g for g, _ in out], np.int32), n=base, v=wide, blob=pa.array(blob, pa.binary()))

    return run


def _gather_sums(batches):
    held: dict[int, list[tuple]] = {}
    for b in batches:
        for g, base, wide, blob in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            held.setdefault(g, []).append((base, wide, blob.as_py()))
    while held:
        _, blobs = held.popitem()
        cols = []
        for base, wide, x in blobs:
            size = 8 if wide else 4
            n = len(x) // (size + 12)
            ids = np.frombuffer(x, np.int64, n) if wide else np.frombuffer(x, np.uint32, n).astype(np.int64) + base
            cols.append((ids, np.frombuffer(x, np.float64, n, size * n) if wide or not n % 2 else np.frombuffer(x[size * n : (size + 8) * n], np.float64), np.frombuffer(x, np.uint32, n, (size + 8) * n)))
        row, sums, known = (np.concatenate(c) for c in zip(*cols, strict=True))
        u, inv = np.unique(row, return_inverse=True)
        yield batch(_row=u, logs=np.bincount(inv, sums), n_known=np.bincount(inv, known).astype(np.int64))


def _ctw_scores(batches):
    """From (block, bucket, body) sorted by both: the block's rows come first, then the logarithms of its grams by bucket."""
    for _, rows in groupby(_rows(batches), itemgetter(0)):
        held = list(pa.ipc.open_stream(next(rows)[2]))
        keys, _, order, _ = block_grams(held)
        tree = ContextTree([])
        tree.known, tree.value = keys, np.empty(len(keys))
        tree.value[order] = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r[2], np.float32) for r in rows)])
        for b in held:
            data, offsets = byte_view(b.column(2))
            score = [tree.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans(offsets, 4 * CHUNK_BYTES)]
            bytes_ = np.diff(offsets)
            n_tokens = np.concatenate([np.diff(word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]) for i, j in spans(offsets)] or [np.zeros(0, np.int64)]) + 1
            total = np.concatenate(score) if score else np.zeros(0)
            bits = np.where(bytes_ > 0, -total / math.log10(2) / np.maximum(bytes_, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_tokens), pa.array(total), pa.array(bits), b.column(3)], names=["doc_id", "held_out", "n_tokens", "score", "bits_per_byte", "_row"])


def tree_scores(rows: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, score, bits_per_byte, _row) of each (doc_id, held_out, text, _row), by a tree of all that are not held out."""
    spark = rows.sparkSession
    width = min(partitions(spark), BUCKETS)
    blocks = materialise(rows.mapInArrow(_blocks, "block long, bucket int, body binary, counts binary"), "op5-blocks")
    learned = blocks.where("bucket >= 0 AND counts IS NOT NULL").select("bucket", "body", "counts")
    merged = materialise(learned.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "bucket int, body binary, counts binary"), "op5-tree")
    release(spark)
    shared = spark.sparkContext.broadcast(_top(merged.where("bucket < 0").toLocalIterator()))
    asked = merged.where("bucket >= 0").select("bucket", F.lit(-1).cast("long").alias("block"), "body", "counts").union(blocks.where("bucket >= 0").select("bucket", "block", "body", F.lit(None).cast("binary")))
    values = asked.repartition(width, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answer(shared), "block long, bucket int, body binary")
    both = blocks.where("bucket < 0").select("block", "bucket", "body").union(values)
    both = both.repartition(partitions(spark), "block").sortWithinPartitions("block", "bucket")
    out = materialise(both.mapInArrow(_ctw_scores, "doc_id long, held_out boolean, n_tokens long, score double, bits_per_byte double, _row long"), "op5-scores")
    release(spark, blocks.scratch, merged.scratch)
    return out


def _row_key() -> F.Column:
    """The id, or a number made of the text where there is none."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61)))


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held_part: int = 1) -> DataFrame:
    """One row per document: the base's counts and score, and the context tree's score and bits per byte."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out_of(id_col, parts, held_part).alias("held_out"), F.col(text_col).alias("text"))
    scored = tree_scores(rows.withColumn("_row", _row_key()).select("doc_id", "held_out", "text", "_row"))

    # Rows that share an id are copies: their sums are divided evenly.
    # A document has a partial sum from each range of words it meets, so there are fewer ranges than partitions.
    width = max(6, partitions(spark) // 2)
    words = rows.select(_row_key().alias("row"), "text", (~F.col("held_out")).alias("learn"))
    packed = words.mapInArrow(_word_postings(width), "bucket int, words binary, docs binary, uses binary").repartition(width, "bucket")
    sums = materialise(packed.mapInArrow(_word_sums(width), "kind int, part int, n long, v long, blob binary"), "op5-sums")
    n, v = sums.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    base = sums.where("kind = 1").select("part", "n", "v", "blob").repartition(width, "part").mapInArrow(_gather_sums, "_row long, logs double, n_known long")
    copies = rows.groupBy(_row_key().alias("_row")).agg(F.count(F.lit(1)).alias("_copies"))
    out = scored.join(base.join(copies, "_row"), "_row")
    share = lambda c: (F.col(c) / F.col("_copies")).cast("long")  # noqa: E731  repeated rows are equal
    norm = math.log10(n + 0.5 * (v + 1))
    return out.select("doc_id", "held_out", "n_tokens", share("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") / F.col("_copies") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score", "bits_per_byte")


def op5_ctw(spark, sf_dir: str) -> DataFrame:
    return lm_scores(read_documents(spark, sf_dir))
