"""Window-like operators: sessions of sorted numbers, line assembly, rows, best passes, renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusters(df: DataFrame, value: str = "value", *, key: str = "scene_id", gap: int = 3) -> DataFrame:
    """Groups of sorted numbers whose neighbours are at most ``gap`` apart: (key, grp, centre, n), centre by banker's rounding."""
    w = Window.partitionBy(key).orderBy(value)
    fresh = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    grouped = df.withColumn("_new", fresh).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "grp").agg(F.bround(F.avg(value)).cast("long").alias("centre"), F.count(F.lit(1)).alias("n"))


def keep_words(df: DataFrame, *, confidence: float = 60.0) -> DataFrame:
    """Words worth keeping: text beyond direction marks, a letter or digit, enough confidence, at least 2 by 2."""
    text = F.trim(F.translate("text", "‎‏", ""))
    return df.withColumn("text", text).where((F.col("text") != "") & (F.try_to_number(F.col("conf").cast("string"), F.lit("999999.999999")).isNotNull() | F.col("conf").isNotNull()) & (F.col("conf") >= confidence) & (F.col("width") >= 2) & (F.col("height") >= 2) & F.col("text").rlike(r"[\p{L}\p{N}]"))


def assemble_lines(df: DataFrame, keys=("page_id", "pass", "line")) -> DataFrame:
    """One row a line: text in order of left edge, bounding box, mean confidence and score."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("left", "ordinal", "text"))), lambda s: s["text"])
    out = df.groupBy(*keys).agg(
        F.array_join(words, " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.avg("conf").alias("conf"),
        F.sum(F.length("text")).alias("chars"),
    )
    return out.withColumn("score", F.col("conf") + F.least(F.lit(20.0), F.lit(1.2) * F.col("chars"))).drop("chars")


def segments(df: DataFrame, keys=("page_id", "line")) -> DataFrame:
    """Words with the segment of their line: a new one where the gap exceeds max(20, 1.6 upper median height)."""
    w = Window.partitionBy(*keys).orderBy("left", "ordinal")
    heights = F.array_sort(F.collect_list("height").over(Window.partitionBy(*keys)))
    median = F.get(heights, F.floor(F.size(heights) / 2).cast("int"))
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(w)
    out = df.withColumn("_new", F.when(gap > F.greatest(F.lit(20.0), median * F.lit(1.6)), 1).otherwise(0))
    return out.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rows(df: DataFrame, key: str = "page_id") -> DataFrame:
    """Words with the row they fall in: a new one where the top moves by more than max(4, 0.65 height)."""
    w = Window.partitionBy(key).orderBy("top", "ordinal")
    fresh = F.when(F.col("top") - F.lag("top").over(w) > F.greatest(F.lit(4.0), F.col("height") * F.lit(0.65)), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best(df: DataFrame, keys, score: str = "score", ordinal: str = "pass") -> DataFrame:
    """The best-scoring row of each group; the first wins a tie."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), ordinal)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def renumber(df: DataFrame, prefix: str = "text", *, key: str = "scene_id", order=("y", "x", "ordinal")) -> DataFrame:
    """Dense ids such as text-001 in reading order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("id", F.format_string(f"{prefix}-%03d", n))


def gaps(df: DataFrame, value: str = "pos", *, key: str = "scene_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(value)
    return df.withColumn("gap", F.lead(value).over(w) - F.col(value)).where("gap IS NOT NULL")


def first_n(df: DataFrame, n: int, *, key: str = "scene_id", order: str = "ordinal") -> DataFrame:
    """At most ``n`` rows of each scene in order of discovery."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


def draw_order(df: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """The drawing position of each node: by z, then by order of appearance."""
    return df.withColumn("draw", F.row_number().over(Window.partitionBy(key).orderBy("z", "ordinal")))


def grid_lines(df: DataFrame, *, key: str = "scene_id") -> DataFrame:
    """A grid node as its inner lines, with derived ids; a grid of one row or column has none that way."""
    def inner(count, name, fraction):
        rows_ = df.where(F.col(count) > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.col(count) - 1)))
        return rows_.select(key, F.format_string(f"%s-{name}-%d", "id", F.col("k")).alias("id"), F.lit(name).alias("axis"), fraction.alias("at"))

    h = inner("rows", "row", F.col("y") + F.col("h") * F.col("k") / F.col("rows"))
    return h.unionByName(inner("columns", "column", F.col("x") + F.col("w") * F.col("k") / F.col("columns")))
