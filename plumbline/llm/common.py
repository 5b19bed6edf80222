"""Helpers shared by the training-data operators: scratch tables, byte-level text views, hashing, packing.

Nothing here keeps state on one machine: what outlives a task is a Parquet table under
``spark.checkpoint.dir``, which every executor and the driver share.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every contract here means it.
WS_CLASS = r"[\x20\x09-\x0D]+"
#: Bytes of text handled at once by the vectorised code; a longer document is handled alone.
CHUNK_BYTES = 1 << 18
_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_ODD, _SEQ_BASE = _U(0x9E3779B97F4A7C15), 0xD1342543DE82EF95 | 1
#: Masks of the first 0 to 8 bytes, and the length beyond which a word is digested by itself.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
LONG_WORD = 4096
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _return_memory() -> None:
    """Have large freed arrays go back to the system at once: workers live on between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # from this size on, memory is mapped for itself
        libc.mallopt(-1, 1 << 20)  # and so much may stay free at the end of the heap
    except OSError:  # another C library
        pass


_return_memory()


def give_back_memory() -> None:
    """Empty Python's free lists and give gaps of the heap back to the system, as far as nothing live lies between."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a local one only where the session names none, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: this cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that are no longer read, and let Spark drop the shuffle files of finished plans."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker is handed at once; a session that asks for fewer rows keeps its setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def normalised(text) -> F.Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS, " ")


def fold(salt: F.Column, n: int) -> F.Column:
    """A stable salt in ``range(n)``."""
    return F.pmod(F.xxhash64(salt), F.lit(n)).cast("int")


# ---------------------------------------------------------------- text as bytes


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of documents of about ``most`` bytes; every document falls in one range as a whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and each document's range in them (n + 1 bounds)."""
    inner = ~_IS_WS[data]
    start, end = inner.copy(), inner.copy()
    if len(data):
        start[1:] &= ~inner[:-1]
        end[:-1] &= ~inner[1:]
        at = offsets[:-1][offsets[:-1] < len(data)]
        start[at] = inner[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        end[at] = inner[at]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, both = max(n, 1 << 16), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word: eight bytes at a time are mixed into it, so words of one length up to eight never collide.

    Each ``seed`` gives an independent hash. Words beyond ``LONG_WORD`` bytes are digested one by one.
    """
    left = ends - starts
    out = mix(left.astype(_U) + _U(seed))
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    long = np.flatnonzero(left > LONG_WORD)
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    who = np.flatnonzero(left <= LONG_WORD) if len(long) else np.arange(len(left))
    at, left = starts[who], left[who]
    while len(at):
        lane = lanes[at] & _LANE[np.minimum(left, 8)]
        out[who] = mix((lane ^ out[who]) * _ODD)
        more = np.flatnonzero(left > 8)
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return out


def hash_windows(words: np.ndarray, k: int, base: int = _SEQ_BASE) -> np.ndarray:
    """A hash for each run of ``k`` words; entry i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    pw, inv = powers(base, len(words))
    c = np.zeros(len(words) + 1, _U)
    np.cumsum(words * pw[: len(words)], out=c[1:])
    return mix((c[k:] - c[:-k]) * inv[:n] + _U(k))


# ---------------------------------------------------------------- packing


def blobs_by_key(batches):
    """(key, blobs) of one key after the other, from rows (key, blob) that come sorted by key."""
    key, blobs = None, []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if k != key and blobs:
                yield key, blobs
                blobs = []
            key = k
            blobs.append(blob.as_buffer())
    if blobs:
        yield key, blobs


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences, so that the high planes compress to nothing."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel())


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the 64-bit space begins in sorted keys (buckets + 1 bounds)."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], _U)
    return np.append(np.searchsorted(keys, edges), len(keys))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
