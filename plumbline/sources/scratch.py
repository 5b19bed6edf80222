"""Cutting long plans: an intermediate result as a table in the folder that all machines share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read again; a local folder only in a local session that names none."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/plumbline/{label}-{uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
