"""Substring deduplication over a log-structured fingerprint index.

The index holds the hashes of all windows of ``WINDOW`` words that were ever taken in, as sorted immutable
runs, one run for each batch and range of the hash space, in a table bucketed by range. A new batch brings its
own windows, packed and sorted by range; they are merge-joined with the runs of their range and with each
other. What matches is verified by 16 bits of a second fingerprint, made from other hashes of the same words, that are
kept beside each hash. The hashes that are new become the batch's run. ``compact`` merges the runs of each range into
one, as a new version of the table; an index that was given a name can be opened again under it.

Before the shuffle each task settles what its own texts decide: of the documents that share a window only the smallest
is sent to the window's range, for the others the match is known. A window that very many documents hold is thus a
posting for each block of windows, not for each document.

``repeated_windows`` takes a corpus in as batches in the order of doc_id, so all that the index holds belongs
to smaller ids; inside a batch the smallest id of each window is its first. The bucketed table is read where it
lies and never shuffled again; a batch's postings are the only thing that crosses the network, and go before
the next batch comes.

Defined results: null or empty text has no words; rows that repeat a doc_id are one document, whose windows
are never removed on account of each other; rows with a null doc_id are neither indexed nor shortened; a text
of fewer than WINDOW words keeps them all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import compress, pairwise
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blobs_by_key, bucket_edges, byte_view, hash_windows, hash_words, materialise, mix, pack_sorted, partitions, read_documents, release, scratch_path, small_batches, spans, unpack_sorted, word_spans

WINDOW = 13
FLUSH = 1 << 19
_U = np.uint64
#: Seed of the words' hashes and base of the sums of the second fingerprint, which have nothing in common with the first's.
_CHECK_SEED, _CHECK_BASE = 0x5851F42D4C957F2D, 0xA0761D6478BD642F | 1
#: Ranges of the hash space for each partition: what one merge holds.
RANGES = 4
#: Bytes of matches that a group of documents should have at most.
GROUP_BYTES = 32 << 20


def windows_of(data: np.ndarray, offsets: np.ndarray, check: bool = True):
    """For all documents: window hash, 16 bits of second fingerprint, document index; windows in order of position."""
    starts, ends, bounds = word_spans(data, offsets)
    key = hash_windows(hash_words(data, starts, ends), WINDOW)
    count = np.diff(bounds)
    stop = np.repeat(bounds[1:], count)[: len(key)]
    doc = np.repeat(np.arange(len(count)), count)[: len(key)]
    ok = np.arange(len(key)) + WINDOW <= stop
    second = (hash_windows(hash_words(data, starts, ends, _CHECK_SEED), WINDOW, _CHECK_BASE) >> _U(48)).astype(np.uint16)[ok] if check else None
    return key[ok], second, doc[ok]


def _pack(key: np.ndarray, check: np.ndarray, doc: np.ndarray | None = None) -> bytes:
    """Sorted keys, their checks and, if given, 32-bit document numbers, as planes."""
    tail = b"" if doc is None else doc.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return pack_sorted(key) + check.tobytes() + tail


def _unpack(blob: bytes, docs: bool) -> tuple[np.ndarray, ...]:
    n = len(blob) // (14 if docs else 10)
    out = (unpack_sorted(blob[: 8 * n]), np.frombuffer(blob, np.uint16, n, 8 * n))
    if docs:
        out += (np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, 10 * n).reshape(4, n).T).view(np.uint32).ravel(),)
    return out


def _matches(docs: np.ndarray, keys: np.ndarray, groups: int):
    """(group, blob) of matches, dealt out by document."""
    part = (mix(docs.view(_U)) % _U(groups)).astype(np.int64)
    order = np.lexsort((keys, docs, part))
    keys, docs, part = keys[order], docs[order], part[order]
    edges = np.searchsorted(part, np.arange(groups + 1))
    return [(g, docs[a:b].tobytes() + keys[a:b].tobytes()) for g, (a, b) in enumerate(pairwise(edges.tolist())) if b > a]


def _postings(buckets: int, groups: int):
    """kind 0: windows by range, with document numbers counted from ``base``; kind 1: matches settled here, of group ``base``."""

    def flush(held):
        key, check, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, check, key))
        key, check, doc = key[order], check[order], doc[order]
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        later = np.concatenate(([False], same & (doc[1:] != doc[:-1])))
        rows = [((int(key[0]) + g) % buckets, 1, g, blob) for g, blob in _matches(doc[later], key[later], groups)]  # any range carries them
        first = np.concatenate(([True], ~same))
        key, check, doc = key[first], check[first], doc[first]
        for high in np.unique(doc >> 32).tolist():
            which = (doc >> 32) == high
            k, c, d = key[which], check[which], doc[which] - (high << 32)
            edges = bucket_edges(k, buckets)
            rows += [(n, 0, high << 32, _pack(k[a:b], c[a:b], d[a:b])) for n, (a, b) in enumerate(pairwise(edges.tolist())) if b > a]
        bucket, kind, base, blob = zip(*rows, strict=True)
        yield batch(bucket=np.array(bucket, np.int32), kind=np.array(kind, np.int32), base=np.array(base, np.int64), blob=pa.array(blob, pa.binary()))

    def run(batches):
        held, n = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offsets = byte_view(b.column(1))
            for i, j in spans(offsets):
                key, check, doc = windows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(key):
                    held.append((key, check, ids[i:j][doc]))
                    n += len(key)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _merge(groups: int, keep: bool):
    """Merge-join one range of a batch with its runs. kind 0: a new run; kind 1: matches of a group of documents."""

    def run(key, new: pa.Table, runs: pa.Table) -> pa.Table:
        out = {"bucket": [], "kind": [], "base": [], "blob": []}

        def put(bucket, kind, base, blob):
            for name, value in zip(out, (bucket, kind, base, blob), strict=True):
                out[name].append(value)

        def table():
            return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "base": pa.array(out["base"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})

        if not new.num_rows:
            return table()
        bucket = new.column("bucket")[0].as_py()
        parts, settled = [], {}
        for kind, base, blob in zip(new.column("kind").to_pylist(), new.column("base").to_pylist(), new.column("blob"), strict=True):
            if kind:
                settled.setdefault(base, []).append(blob.as_buffer())
            else:
                k, c, d = _unpack(blob.as_py(), True)
                parts.append((k, c, d.astype(np.int64) + base))
        for g, blobs in settled.items():
            put(g, 1, 0, b"".join([memoryview(x)[: x.size // 2] for x in blobs] + [memoryview(x)[x.size // 2 :] for x in blobs]))
        if not parts:
            return table()
        keys, checks, docs = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.argsort(keys, kind="stable")
        keys, checks, docs = keys[order], checks[order], docs[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        runs_of = np.diff(np.append(first, len(keys)))
        earliest, agreed = np.minimum.reduceat(docs, first), np.maximum.reduceat(checks, first) == np.minimum.reduceat(checks, first)
        unique, check = keys[first], checks[first]
        # One hash with two second fingerprints is told apart in full; such hashes are next to none.
        odd = {}
        for g in np.flatnonzero(~agreed).tolist():
            a, n = first[g], runs_of[g]
            for c in np.unique(checks[a : a + n]).tolist():
                odd[(g, c)] = int(docs[a : a + n][checks[a : a + n] == c].min())
        known = np.zeros(len(unique), bool)
        for blob in runs.column("blob") if runs.num_rows else ():
            k, c = _unpack(blob.as_py(), False)
            at = np.minimum(np.searchsorted(k, unique), len(k) - 1)
            hit = k[at] == unique
            known |= hit & (c[at] == check)
            for g, c2 in list(odd):
                if hit[g] and c[at[g]] == c2:
                    odd[(g, c2)] = -(1 << 63)
        group = np.repeat(np.arange(len(first)), runs_of)
        removed = known[group] | (docs > earliest[group])
        for g in {g for g, _ in odd}:
            a, n = first[g], runs_of[g]
            removed[a : a + n] = [int(d) > odd[(g, int(c))] for d, c in zip(docs[a : a + n], checks[a : a + n], strict=True)]
        if keep:
            fresh = ~known
            put(bucket, 0, 0, _pack(unique[fresh], check[fresh]))
        for g, blob in _matches(docs[removed], keys[removed], groups):
            put(g, 1, 0, blob)
        return table()

    return run


def _by_document(batches):
    """Gather the matches of one group of documents after the other: (doc_id, sorted hashes of its removed windows)."""
    for _, blobs in blobs_by_key(batches):
        d = np.concatenate([np.frombuffer(x, np.int64, x.size // 16) for x in blobs])
        k = np.concatenate([np.frombuffer(x, _U, x.size // 16, x.size // 2) for x in blobs])
        order = np.lexsort((k, d))
        d, k = d[order], k[order]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        stops = np.append(first[1:], len(d))
        for at in range(0, len(first), 1024):
            part = [(a, b) for a, b in zip(first[at : at + 1024].tolist(), stops[at : at + 1024].tolist(), strict=True)]
            yield batch(_of=d[first[at : at + 1024]], hits=pa.array([np.unique(k[a:b]).tobytes() for a, b in part], pa.binary()))


class FingerprintIndex:
    """Sorted runs of window hashes in a bucketed table, and the merge-join of new batches with them.

    A named index lies in tables ``<name>_v<version>`` and stays; opening the name again takes the newest version, which
    a compaction makes visible only as a whole. Without a name it is dropped by ``close``.
    """

    #: With so many runs in a range they are merged before the next batch.
    RUNS = 2

    def __init__(self, spark, buckets: int | None = None, *, name: str | None = None):
        self.spark, self.kept, self.version, self.runs = spark, name is not None, 0, 0
        self.name = (name or f"plumbline_runs_{uuid4().hex[:12]}").lower()
        found = [int(r["tableName"].rsplit("_v", 1)[1]) for r in spark.sql(f"SHOW TABLES LIKE '{self.name}_v*'").collect() if r["tableName"].rsplit("_v", 1)[0] == self.name]
        if found:
            self.version = max(found)
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.table}").collect()}
            self.buckets, self.path = int(about["Num Buckets"]), about["Location"]
            self.runs = spark.table(self.table).groupBy("bucket").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        else:
            self.buckets, self.path = buckets or RANGES * partitions(spark), scratch_path(spark, "op8-runs")
            self._write(spark.createDataFrame([], "bucket int, blob binary"), "overwrite")

    @property
    def table(self) -> str:
        return f"{self.name}_v{self.version}"

    def _write(self, runs: DataFrame, mode: str) -> None:
        runs.write.mode(mode).bucketBy(self.buckets, "bucket").option("path", self.path).saveAsTable(self.table)

    def take_in(self, docs: DataFrame, *, keep: bool = True, groups: int = 8) -> DataFrame:
        """Matches (group, blob) of a batch whose ids are all larger than the index's; with ``keep`` its new run is added.

        ``groups`` is how many groups of documents the matches are dealt to.
        """
        new = docs.mapInArrow(_postings(self.buckets, groups), "bucket int, kind int, base long, blob binary").repartition(self.buckets, "bucket")
        runs = self.spark.table(self.table)
        merged = new.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(_merge(groups, keep), "bucket int, kind int, base long, blob binary")
        merged = materialise(merged, "op8-merged")
        if keep:
            self._write(merged.where("kind = 0").select("bucket", "blob"), "append")
            self.runs += 1
        hits = materialise(merged.where("kind = 1").select(F.col("bucket").alias("group"), "blob"), "op8-hits")
        release(self.spark, merged.scratch)
        return hits

    def compact(self) -> None:
        """Merge the runs of each range into one sorted run; the old runs go when the new table is complete."""

        def run(runs):
            parts = [_unpack(b.as_py(), False) for b in runs.column("blob")]
            k, c = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(k, kind="stable")
            return pa.table({"bucket": runs.column("bucket")[:1], "blob": pa.array([_pack(k[order], c[order])], pa.binary())})

        merged = self.spark.table(self.table).groupBy("bucket").applyInArrow(run, "bucket int, blob binary")
        old_table, old_path = self.table, self.path
        self.version, self.path = self.version + 1, scratch_path(self.spark, "op8-runs")
        self._write(merged, "overwrite")
        self.spark.sql(f"DROP TABLE {old_table}")
        release(self.spark, old_path)
        self.runs = 1

    def close(self) -> None:
        if not self.kept:
            self.drop()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        release(self.spark, self.path)


def repeated_windows(docs: DataFrame, batches: int = 4, index: FingerprintIndex | None = None) -> DataFrame:
    """(_of, hits): for each document with removed windows their sorted hashes.

    With an ``index`` that was given, all of ``docs`` is taken into it and its ids must be larger than those before.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    marks = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    edges = [None, *(int(m) for m in marks), None]
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    own, found = index or FingerprintIndex(spark), []
    groups = int(min(own.buckets, max(8, 3 * size // GROUP_BYTES)))  # a match has 16 bytes, a word some six
    try:
        for n, (lo, hi) in enumerate(pairwise(edges)):
            part = docs
            part = part if lo is None else part.where(F.col("doc_id") > lo)
            part = part if hi is None else part.where(F.col("doc_id") <= hi)
            if own.runs >= own.RUNS:
                own.compact()
            found.append(own.take_in(part, keep=index is not None or n < len(edges) - 2, groups=groups))
    finally:
        if index is None:
            own.close()
    hits = reduce(DataFrame.union, found).repartition(partitions(spark), "group").sortWithinPartitions("group")
    out = materialise(hits.mapInArrow(_by_document, "_of long, hits binary"), "op8-by-document")
    release(spark, *(h.scratch for h in found))
    return out


def _shorten(batches):
    """Words, removed words and digest of what is left, of each whole text."""
    for b in batches:
        data, offsets = byte_view(b.column(1))
        hits = b.column(2)
        for i, j in spans(offsets):
            rows = []
            for n in range(i, j):
                raw = data[offsets[n] : offsets[n + 1]]
                words = raw.tobytes().split()
                gone = hits[n].as_py()
                removed = 0
                if gone:
                    key, _, _ = windows_of(raw, np.array([0, len(raw)]), check=False)
                    gone = np.frombuffer(gone, _U)
                    at = np.minimum(np.searchsorted(gone, key), len(gone) - 1)
                    starts = np.flatnonzero(gone[at] == key)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, np.minimum(starts + WINDOW, len(words)), -1)
                    left = np.cumsum(cover[:-1]) == 0
                    removed = int(len(words) - left.sum())
                    kept = b" ".join(compress(words, left.tolist()))
                else:
                    kept = b" ".join(words)
                rows.append((len(words), removed, hashlib.sha256(kept).hexdigest()))
            n_words, n_removed, sha = zip(*rows, strict=True)
            yield batch(doc_id=b.column(0).slice(i, j - i), n_words=np.array(n_words, np.int64), n_removed=np.array(n_removed, np.int64), kept_sha256=pa.array(sha, pa.string()))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; windows of an earlier ``index`` count as repeats, too."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = repeated_windows(docs, index=index)
    joined = docs.join(hits, docs["doc_id"] == hits["_of"], "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(_shorten, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))
