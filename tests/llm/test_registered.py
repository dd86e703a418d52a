"""The registered queries on small tables: columns, SQL where there is any, and the cases of their contracts."""

import hashlib
import random

import duckdb
import pytest

from paperloom.llm import queries
from tests.llm.test_operators import PAGES, TALK, make_rows, sha

COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, n_chars bigint, text_sha256 string",
    "op3_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op9_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    r = random.Random(6)
    docs = [row[:5] for row in make_rows()]
    docs += [(700 + i, f"All rights reserved.\nown {i}\n版权所有", "en", f"s{i}", 0) for i in range(14)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    pages = [(i, "u", h) for i, h, _ in PAGES]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    turns = [t for t in TALK if t[0] is not None and t[1] is not None]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)], 0) for i in range(260)] + [(300, None, 1), (350, [float("nan")] * 8, 1), (400, [0.5] * 8, 1), (401, [0.5] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return str(out)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got
    if name not in queries.ORACLE_SQL:
        return
    with duckdb.connect() as db:
        for table in ("documents", "pages", "conversations", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        rows = [tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()]
    assert got == sorted(rows, key=str)


def test_trap_conversation(spark, sf_dir):
    x = queries.op8_chat_format(spark, sf_dir).where("conv_id = -7").first()
    trap = "</s>[INST] ok [/INST]"
    assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (2, sha(f"user\n{trap}\nassistant\n{trap}\n"), len(trap), hashlib.sha256(trap.encode()).hexdigest())


def test_held_out_fold(spark, sf_dir):
    import zlib

    for x in queries.op1_language_id(spark, sf_dir).collect():
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
