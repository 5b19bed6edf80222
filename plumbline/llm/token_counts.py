"""Token counts by scanning flat token files for the end-of-document identifier.

A flat token file is a run of 16-bit little-endian identifiers without any index: documents one after the
other, each closed by the end-of-document identifier. Here a document begins with ``HEADER`` identifiers that
spell its doc_id in base 32,768, which never look like a separator; files of other writers have none.

Files are scanned in blocks. Every block is compared with the separator at once; a prefix sum over the blocks'
separator counts numbers the documents, and a running maximum of the last separator seen carries the start of
a document that a block leaves open into the next, whichever block it ends in.

Files are written by Spark's text sink with the separator as line end, so they may lie in any store that
Spark knows, and are read back one file a row; ``MAX_DOCS_PER_FILE`` bounds a file.

Defined results: null text counts as empty and has 0 tokens; special tokens' strings in a text are ordinary text,
so a text never holds a separator; rows may repeat, ids may be null; tokens after a file's last separator are
reported as one more document only by ``scan_file(..., closed=False)``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, load
from .common import batch, read_documents, scratch_path

EOD = 49407
HEADER = 5
BLOCK_TOKENS = 1 << 19
MAX_DOCS_PER_FILE = 50_000
_NULL = 1 << 70


def header(doc_id: int | None) -> list[int]:
    """The identifiers that spell a doc_id, the highest first."""
    n = _NULL if doc_id is None else doc_id & ((1 << 64) - 1)
    return [(n >> (15 * k)) & 32767 for k in reversed(range(HEADER))]


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> None:
    """Tokenise whole texts and write them as flat token files to the folder ``path``."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        bpe = load(vocabulary, specials=False)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [np.array(header(i) + bpe.encode(t), "<u2").tobytes() for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield batch(value=pa.array(rows, pa.binary()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "value binary")
    end = np.array([EOD], "<u2").tobytes().decode("latin-1")
    rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", MAX_DOCS_PER_FILE).text(path)


def scan_file(content: bytes, *, block: int = BLOCK_TOKENS, closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of identifiers (separator not counted) of each document of one flat file."""
    tokens = np.frombuffer(content, "<u2", len(content) // 2)
    found = [np.flatnonzero(tokens[a : a + block] == EOD) for a in range(0, len(tokens), block)]
    counts = np.array([len(f) for f in found], np.int64)
    base = np.cumsum(counts) - counts  # documents closed before each block
    last = np.maximum.accumulate([f[-1] + k * block if len(f) else -1 for k, f in enumerate(found)]) if found else np.zeros(0, np.int64)
    starts, sizes = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()), np.int64)
    for k, f in enumerate(found):
        if len(f):
            ends = f + k * block
            begin = np.concatenate(([last[k - 1] + 1 if k else 0], ends[:-1] + 1))
            starts[base[k] : base[k] + len(f)] = begin
            sizes[base[k] : base[k] + len(f)] = ends - begin
    if not closed and len(tokens) and (not len(last) or last[-1] + 1 < len(tokens)):
        tail = int(last[-1]) + 1 if len(last) else 0
        starts, sizes = np.append(starts, tail), np.append(sizes, len(tokens) - tail)
    return starts, sizes


def _counts(batches):
    for b in batches:
        for content in b.column(0):
            content = content.as_py()
            tokens = np.frombuffer(content, "<u2", len(content) // 2)
            starts, sizes = scan_file(content)
            ids = np.zeros(len(starts), np.int64)
            null = np.zeros(len(starts), bool)
            for k in range(HEADER):
                digit = tokens[starts + k].astype(np.int64) if len(starts) else ids
                null |= (digit >> 10 & 1).astype(bool) if k == 0 else False
                ids = (ids << 15) | digit
            for at in range(0, len(starts), 8192):
                part = slice(at, at + 8192)
                yield batch(doc_id=pa.array(ids[part], mask=null[part]), n_tokens=sizes[part] - HEADER)


def token_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every document of the flat files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").mapInArrow(_counts, "doc_id long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op7-tokens")
    write_token_files(read_documents(spark, sf_dir), path)
    return token_counts(spark, path)
