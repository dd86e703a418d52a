"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, chat_format, html_extract, language_id, line_dedup, ngram_join, packing, quality_rules, substring_dedup, topk_search

VOCABULARY = "word_bpe_49k.json"
#: A conversation whose texts hold the template's own control strings.
_TRAP = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sample = language_id.labelled_sample(docs, ~language_id.held_out())
    out = language_id.predict_language(docs, sample)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract_text(pages, html_extract.labelled_pages(pages))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRAP).alias("text"))
    return chat_format.digest(chat_format.format_windows(turns.unionByName(trap)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(_table(spark, sf_dir, "documents")).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_line_dedup, op3_html_extraction, op4_packing, op5_ngram_jaccard_join,
        op6_exact_topk, op7_bpe, op8_chat_format, op9_substring_dedup, op10_quality_rules,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, trim(line, {_BLANKS}) AS key FROM l),
w AS (SELECT * FROM k WHERE key <> ''),
b AS (SELECT key, min({{'d': doc_id, 'p': pos}}) AS first FROM w GROUP BY key HAVING count(DISTINCT source) >= 10),
g AS (SELECT w.doc_id, w.pos FROM w JOIN b USING (key) WHERE NOT (w.doc_id = b.first.d AND w.pos = b.first.p)),
t AS (
  SELECT k.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY k.pos) FILTER (g.pos IS NULL), '') AS text
  FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.pos = k.pos GROUP BY k.doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t""",
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
