"""Carrier views: relations of the engine derived by arithmetic from general tables.

No scenes come with the test data, so scenes, words, rasters and jobs are derived from its tables by rules that
any SQL engine can repeat. They are synthetic carriers for real operators; the operators know nothing of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import RELATIONS

_NODE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_NODE_ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(w))


def _node_columns(x):
    return [
        F.col("l_orderkey").alias("scene_id"),
        F.format_string("n%03d", F.col("ordinal")).alias("id"),
        F.col("l_linenumber").alias("raw_id"),
        "ordinal",
        F.expr("CASE WHEN l_returnflag = 'A' THEN 'text' WHEN l_returnflag = 'R' THEN 'rounded_rectangle' WHEN l_linestatus = 'O' THEN 'rectangle' ELSE 'image' END").alias("type"),
        x.alias("x"),
        ((F.col("l_suppkey") % 80) / F.lit(100.0)).alias("y"),
        (F.lit(0.02) + F.col("l_quantity") / 50 * 0.18).alias("w"),
        (F.lit(0.02) + F.col("l_tax")).alias("h"),
        F.col("l_linenumber").alias("z"),
        F.expr("CASE WHEN ordinal > 1 THEN format_string('n%03d', ordinal - 1) END").alias("parent"),
    ]


def nodes(spark, sf_dir) -> DataFrame:
    return _numbered(spark, sf_dir).select(*_node_columns((F.col("l_partkey") % 80) / F.lit(100.0)))


def actuals(spark, sf_dir) -> DataFrame:
    rows = _numbered(spark, sf_dir).where("NOT (l_returnflag = 'N' AND l_linenumber % 7 = 0)")
    return rows.select(*_node_columns((F.col("l_partkey") % 80) / F.lit(100.0) + F.col("l_discount") / 3))


def constraints(spark, sf_dir) -> DataFrame:
    """Each node with the next one of its scene, the relation dealt by number."""
    n = nodes(spark, sf_dir)
    nxt = F.lead("id").over(Window.partitionBy("scene_id").orderBy("ordinal"))
    kinds = F.array(*[F.lit(r) for r in RELATIONS])
    return n.select("scene_id", F.col("ordinal").alias("idx"), F.element_at(kinds, ((F.col("scene_id") + F.col("ordinal")) % len(RELATIONS) + 1).cast("int")).alias("type"), F.col("id").alias("source"), nxt.alias("target")).where("target IS NOT NULL")


def words(spark, sf_dir) -> DataFrame:
    """Words of documents laid in lines of ten, in three passes."""
    w = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "[ \n]")).alias("i", "text"))
    return w.select(
        "page_id",
        F.element_at(F.array(F.lit(11), F.lit(3), F.lit(6)), (F.col("page_id") % 3 + 1).cast("int")).alias("pass"),
        F.expr("CAST(i DIV 10 AS INT)").alias("line"),
        F.col("i").alias("ordinal"),
        ((F.col("i") % 10) * 60 + F.col("i") * 7 % 13 * 5).cast("int").alias("left"),
        (F.expr("CAST(i DIV 10 AS INT)") * 20 + F.col("i") * 5 % 7).cast("int").alias("top"),
        (F.length("text") * 6).cast("int").alias("width"),
        (F.lit(10) + F.col("i") % 5).cast("int").alias("height"),
        (F.lit(40.0) + (F.col("i") * 37 + F.col("page_id") * 11) % 60).alias("conf"),
        "text",
    )


def rasters(spark, sf_dir) -> DataFrame:
    """Each vector as an 8 x 8 raster of luma, row by row."""
    lo, hi = F.array_min("embedding"), F.array_max("embedding")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", lo.cast("double").alias("lo"), (hi.cast("double") - lo.cast("double")).alias("range"))
    luma = F.transform("embedding", lambda v: F.when(F.col("range") == 0, F.lit(0)).otherwise(F.bround(F.lit(255.0) * (v.cast("double") - F.col("lo")) / F.col("range")).cast("int")))
    return e.select("vec_id", luma.alias("luma"))


def hash_rasters(spark, sf_dir) -> DataFrame:
    """Each vector as nine by eight luma: its 64 and the first eight again."""
    return rasters(spark, sf_dir).select("vec_id", F.concat("luma", F.slice("luma", 1, 8)).alias("luma"))


def color_rasters(spark, sf_dir) -> DataFrame:
    """Each vector as 21 colour pixels: three luma after the other; the last one is left over."""
    pixel = lambda i: F.struct(*[F.get("luma", 3 * i + k).alias(c) for k, c in enumerate("rgb")])
    return rasters(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), pixel).alias("pixels"))


def scene_nodes(spark, sf_dir) -> DataFrame:
    """Nodes with text, style and image columns."""
    n = nodes(spark, sf_dir)
    return n.withColumns(
        {
            "value": F.expr("CASE WHEN type = 'text' THEN concat('T', raw_id, ' x') END"),
            "direction": F.expr("CASE WHEN type = 'text' THEN CASE ordinal % 3 WHEN 0 THEN 'rtl' WHEN 1 THEN 'ltr' ELSE 'mixed' END END"),
            "color": F.expr("CASE WHEN type = 'text' THEN concat('#00000', raw_id) END"),
            "stroke_width": F.expr("CASE WHEN type <> 'text' THEN CAST(z % 3 AS DOUBLE) END"),
            "raster_justification": F.expr("CASE WHEN type = 'image' THEN CASE ordinal % 4 WHEN 0 THEN 'source_photo' WHEN 1 THEN 'source_artwork' WHEN 2 THEN NULL ELSE 'wallpaper' END END"),
            "content_ref": F.expr("CASE WHEN type = 'image' THEN CASE WHEN z % 2 = 0 THEN 'reference-region:1' ELSE 'upload:1' END END"),
        }
    )


def objects(spark, sf_dir) -> DataFrame:
    """Recovered objects with the kind of their shape; images grow so that some fill pages."""
    a = actuals(spark, sf_dir)
    grown = a.withColumns({"w": F.expr("CASE WHEN type = 'image' THEN w * 3 ELSE w END"), "h": F.expr("CASE WHEN type = 'image' THEN h * 8 ELSE h END")})
    return grown.withColumn("shape_type", F.expr("CASE WHEN type = 'image' THEN CASE WHEN z % 2 = 0 THEN 'GraphicObjectShape' ELSE 'TextFrame' END ELSE 'CustomShape' END"))


def packages(spark, sf_dir) -> DataFrame:
    """(scene_id, integrity, dhash) of each scene's package and its source."""
    n = nodes(spark, sf_dir).select("scene_id").distinct()
    return n.select("scene_id", (F.col("scene_id") % 17 != 0).alias("integrity"), (F.col("scene_id") * 7919).alias("dhash"))


def media(spark, sf_dir) -> DataFrame:
    """(scene_id, name, dhash): one media part for each image of a scene."""
    i = nodes(spark, sf_dir).where("type = 'image'")
    name = F.expr("concat('word/media/image', ordinal, CASE WHEN ordinal % 5 = 0 THEN '.EMF' ELSE '.png' END)")
    return i.select("scene_id", name.alias("name"), (F.col("scene_id") * 7919).bitwiseXOR(F.expr("CASE WHEN ordinal % 3 = 0 THEN 5L ELSE 1023L END")).alias("dhash"))


def package_texts(spark, sf_dir) -> DataFrame:
    """(scene_id, text): the values of most text nodes of a scene, in order."""
    n = scene_nodes(spark, sf_dir).where("type = 'text' AND ordinal % 6 <> 5")
    return n.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda s: s["value"]), "  ").alias("text"))


def read_texts(spark, sf_dir) -> DataFrame:
    """(scene_id, id, text) read from image regions; null where nothing could be read."""
    i = nodes(spark, sf_dir).where("type = 'image'")
    return i.select("scene_id", "id", F.expr("CASE WHEN raw_id % 3 = 0 THEN concat('t', raw_id, ' y') WHEN raw_id % 3 = 2 AND scene_id % 5 = 0 THEN NULL ELSE '' END").alias("text"))


def raster_pairs(spark, sf_dir) -> DataFrame:
    """Each raster with that of the next number."""
    r = rasters(spark, sf_dir)
    return r.alias("a").join(r.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select("a.vec_id", F.col("a.luma").alias("reference"), F.col("b.luma").alias("rendered"))


def jobs(spark, sf_dir) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), F.expr("CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'FIDELITY_FAILED' WHEN 1 THEN 'PACKAGE_INVALID' WHEN 2 THEN 'E2' ELSE 'TIMEOUT' END END").alias("error_code"))


#: Gates of the carrier in policy order.
GATES = ("G_AUDIT", "G_QUALITY", "G_CLEAN", "G_SIZE")


def gates(spark, sf_dir) -> DataFrame:
    """(doc_id, gate, ordinal, passed) of labelled documents."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    tests = F.array(
        F.struct(F.lit(GATES[0]).alias("gate"), (F.col("doc_id") % 11 != 0).alias("passed")),
        F.struct(F.lit(GATES[1]).alias("gate"), (F.col("quality") == 1).alias("passed")),
        F.struct(F.lit(GATES[2]).alias("gate"), (F.col("toxic") == 0).alias("passed")),
        F.struct(F.lit(GATES[3]).alias("gate"), (F.col("n_chars") >= 200).alias("passed")),
    )
    return d.select("doc_id", F.posexplode(tests).alias("ordinal", "t")).select("doc_id", "t.gate", "ordinal", "t.passed")
