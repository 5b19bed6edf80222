"""Readers and sinks of the engine's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCR_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
SCENE_SCHEMA = "version string, page struct<width:double,height:double,orientation:string>, nodes array<struct<id:string,type:string,bbox:array<double>,z:int,editable:boolean,parent:string>>, constraints array<struct<type:string,source:string,target:string,tolerance:double>>"


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated OCR words with a header; malformed numbers become null."""
    return spark.read.schema(OCR_SCHEMA).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One scene a file: (path, scene, error); a file that is not JSON is SCENE_JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.withColumn("v", F.try_parse_json("value")).withColumn("scene", F.from_json("value", SCENE_SCHEMA))
    return parsed.select("path", "scene", F.when(F.col("v").isNull(), "SCENE_JSON").alias("error"))


def scene_nodes(scenes: DataFrame, *, key: str = "path") -> DataFrame:
    n = scenes.select(key, F.posexplode("scene.nodes").alias("ordinal", "n"))
    return n.select(F.col(key).alias("scene_id"), "ordinal", "n.id", "n.type", *[F.get("n.bbox", i).alias(c) for i, c in enumerate("xywh")], "n.z", "n.editable", "n.parent")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("docx_id"), "content")


def write_bundle(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines with keys in order."""
    reports.select(F.to_json(F.struct(*sorted(reports.columns))).alias("value")).write.text(path)


def preview_rung(sizes) -> F.Column:
    """The first rung of a quality ladder, an array of (side, quality, bytes), that is within 64 KiB; null for none."""
    return F.get(F.filter(sizes, lambda s: s["bytes"] <= 65536), 0)


def put(spark: SparkSession, rows: DataFrame, path: str, now, hours: int = 24) -> None:
    """Append records that expire after ``hours``."""
    rows.withColumn("expires_at", F.lit(now).cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))).write.mode("append").parquet(path)


def live(spark: SparkSession, path: str, now) -> DataFrame:
    """Records that are not expired."""
    return spark.read.parquet(path).where(F.col("expires_at") > F.lit(now).cast("timestamp"))
