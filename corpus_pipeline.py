"""A cleaning pipeline over documents: each stage's result is written and read again as the next one's documents.

Removed are what the quality rules reject, all but the first of each group of near
copies, and documents with benchmark passages; secrets are masked in the text; what is
left is packed into sequences.

Nulls: a document without text is rejected by the quality rules (it has no words), rows with a null doc_id, lang or other
column go through like others. Repeated rows are copies: one stays. Of near copies the one with the least doc_id stays.
Texts are read whole, whatever their length. Further columns of documents, whatever their names, are carried to the last
stage, which has its own. Without documents each stage is empty; without labels only the base rules reject, and without
a benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seams.llm import decontaminate, jaccard_join, packing, quality, secrets
from seams.llm.queries import tokenizer_path
from seams.llm.store import materialize, scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("jaccard", distinct),
    ("decontaminate", clean),
    ("secrets", masked),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=1)
    return docs


#: Neither exact binomial bounds, components of Jaccard links nor BPE ids can be had in SQL.
ORACLE_SQL: str | None = None
