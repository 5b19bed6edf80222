"""A corpus pipeline of five stages over documents; each stage's decisions take effect before the next.

Language ID drops what it rejects; exact dedup keeps the smallest id of equal texts; the Jaccard join keeps the
smallest id of each component; decontamination drops documents that leak a benchmark item; BPE tokenises the
rest. All stages but the last return the columns of documents.

Defined results: a null or empty text has no letter and goes with the language stage; without any labelled language
that stage rejects nothing. Of equal texts the smallest id stays; a row with a null id goes where another row has its
text with an id. Rows that repeat an id go together when that id is dropped by the third or fourth stage. Empty tables
pass through all stages; extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from plumbline.llm.common import materialise


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs.where(~language_id.held_out_of("doc_id", 4, 2))))


def stage_exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def stage_jaccard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, jaccard_join.link_components(docs).where("doc_id > component_id"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.leaking_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs)


STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("ngram_jaccard_join", stage_jaccard),
    ("benchmark_decontamination", stage_decontaminate),
    ("bpe", stage_bpe),
]
#: SQL cannot express language models, byte-pair merges or components; the stages' operators have brute-force tests of their own.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
