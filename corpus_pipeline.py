"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of the documents table, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return those columns, and extra ones as they
are; a text that a stage cuts gets its new n_chars. An empty table stays empty in every stage, and texts of any length
are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Stored, free_name
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.quality_lm import classify

TOKENIZER = "word_bpe_49k.json"


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents but those that are not kept. Both sides are dealt by key at any size: what goes grows with the input."""
    name = free_name(docs, "gone")
    gone = Stored(decided.where(~F.col("kept")).select(F.col("doc_id").alias(name)), "gone").df
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col(name), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, those without a word (null, empty or blank text) among them.

    Rows of one key are judged together and go or stay together; rows without a key are not judged and stay.
    """
    return _without(docs, classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents of which nothing is left.

    A null or empty text stays as it is. Rows that repeat a key and text are one document, cut alike; rows without a key
    stay as they are.
    """
    cut = dedup_lines(docs)
    lines, deleted = cut.columns[-2:]
    left = cut.where((F.col(deleted) == 0) | (F.col(deleted) < F.col(lines)))
    return left.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest key stays, once where its row is repeated.

    A text without a word is nobody's duplicate and stays; rows without a key stay as they are.
    """
    left = _without(docs, near_duplicates(docs))
    keyed = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])  # dealt by key already
    return keyed.union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts, row by row, whatever the key; a null text stays null."""
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, as the packing operator returns them: each row is a document, a null text an empty one."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the second is within SQL's reach; tests hold each stage against a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), f"stage-{name}").df
    return docs
