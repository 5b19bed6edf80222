"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Three narrowings, each a partial (map-side) aggregate over what the one before left:

1. rows are counted by the length of their normalised text; lengths met once are settled;
2. the others are counted by (length, hash of the first characters); pairs met once are settled;
3. only the full contents of the rows that are left are hashed (SHA-256) and grouped.

The text itself never crosses the network. Which (length, prefix) pairs survive reaches the second scan as
a bitmap of a fixed number of bits: it lets a few settled rows through (they are told apart by the full
hash) and drops none that matters, so its size needs no relation to the data.

Defined results: null text counts as empty; equal texts form one group of any size; each row
has the decision of its own text, also where a doc_id repeats or is null; a null doc_id never keeps a group that has another id;
an empty table gives an empty result. Extra columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, normalised, read_documents

#: A third of all rows may be one group: group totals are dealt to this many partitions each.
SALTS = 16
BITS_PER_ROW = 32768
#: The hash of a row's own text by which decisions are joined back, besides its id.
OWN = "__exact_dedup_own"


def _own(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _fingerprint(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), _own(F.col(text_col)).alias("_own"), norm.alias("_norm")).select(
        "_id", "_own", "_norm", F.length("_norm").alias("_len"), F.xxhash64(F.length("_norm"), F.substring("_norm", 1, prefix)).alias("_prefix")
    )


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row per 32,768 bits that has a bit set: (bucket, map)."""
    at = F.pmod("_prefix", F.lit(bits)) + 1
    return keys.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def _flagged(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose bit is set. The bitmap has at most bits / 32,768 rows of 4 KiB, so it may be broadcast."""
    at = F.pmod("_prefix", F.lit(bits)) + 1
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bitmap), "_bucket").where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).drop("_bucket", "_bit", "_map")


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, bits: int = 1 << 23) -> DataFrame:
    """Rows that share length and prefix hash with another row: (_id, _own, _len, _prefix, _norm), settled ones left out."""
    rows = _fingerprint(docs, id_col, text_col, prefix)
    classes = rows.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    shared_length = classes.groupBy("_len").agg(F.sum("_n").alias("_of_len")).where("_of_len > 1")
    shared_prefix = classes.where("_n > 1").join(shared_length, "_len", "left_semi")
    return _flagged(rows, materialise(_bitmap(shared_prefix, bits), "op1-bitmap"), bits)


def _decisions(docs: DataFrame, *, id_col: str, text_col: str, prefix: int = 64, bits: int = 1 << 23) -> DataFrame:
    """(doc_id, OWN, keep_id, group_size) of the rows that have an equal, once for each id and text."""
    left = survivors(docs, id_col=id_col, text_col=text_col, prefix=prefix, bits=bits)
    left = materialise(left.select("_id", "_own", "_len", F.unhex(F.sha2("_norm", 256)).alias("_hash")), "op1-hashes")
    groups = left.groupBy("_len", "_hash").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = left.withColumn("_salt", fold(F.col("_id"), SALTS)).join(groups, ["_len", "_hash", "_salt"])
    return found.select(F.col("_id").alias("doc_id"), F.col("_own").alias(OWN), "keep_id", "group_size").distinct()


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, bits: int = 1 << 23) -> DataFrame:
    """(doc_id, keep_id, group_size) of the rows that have an equal; every other row is alone in its group."""
    return _decisions(docs, id_col=id_col, text_col=text_col, prefix=prefix, bits=bits).drop(OWN).distinct()


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: of equal texts, the smallest id."""
    dropped = _decisions(docs, id_col=id_col, text_col=text_col).where("doc_id > keep_id OR (doc_id IS NULL AND keep_id IS NOT NULL)")
    dropped = dropped.select(F.col("doc_id").alias("_gone"), F.col(OWN).alias("_gone_own"))
    rows = docs.withColumn(OWN, _own(F.col(text_col)))
    return rows.join(dropped, rows[id_col].eqNullSafe(dropped["_gone"]) & (rows[OWN] == dropped["_gone_own"]), "left_anti").drop(OWN)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    docs = read_documents(spark, sf_dir)
    groups = _decisions(docs, id_col="doc_id", text_col="text").select(F.col("doc_id").alias("_of"), F.col(OWN).alias("_of_own"), "keep_id", "group_size")
    digest = docs.select("doc_id", _own(F.col("text")).alias(OWN), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    joined = digest.join(groups, digest["doc_id"].eqNullSafe(groups["_of"]) & (digest[OWN] == groups["_of_own"]), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
