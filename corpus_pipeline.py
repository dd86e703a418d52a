"""The corpus pipeline: quality rules, line dedup, near-duplicates, substring dedup, packing.

Each stage takes the documents that its predecessor kept, as they stand in shared storage.

Defined cases, in every stage: rows are judged and cut each by its own text, also where they share a
doc_id; rows with a null doc_id come last in any order and are treated like others; a null text fails the
quality rules; extra columns, whatever their names, pass through all stages but the last; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup
from paperloom.llm._blocks import as_before
from paperloom.llm._session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _has_words(text: str):
    return F.col(text).rlike(r"[^\x20\x09-\x0D]")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def _kept(docs: DataFrame, cut: DataFrame, removed: str) -> DataFrame:
    """The columns of ``docs`` of rows (row, text) that lost nothing or still have words; n_chars follows the text."""
    out = cut.where((F.col(removed) == 0) | F.coalesce(_has_words("text"), F.lit(False)))
    if "n_chars" in docs.columns:
        n = F.when(F.col(removed) == 0, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("row", F.col("row").withField("n_chars", n))
    return as_before(docs, out)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that held nothing but other documents' boilerplate go with it."""
    return _kept(docs, line_dedup.cut_documents(docs), "n_lines_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that held nothing but repeated passages go with them."""
    return _kept(docs, substring_dedup.cut_documents(docs), "n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("packing", pack),
]

#: Packing by retrieval has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
