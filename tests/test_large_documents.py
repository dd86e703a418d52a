"""Round trips of documents that are larger than what the formats hold in one piece, and what they cost."""

import duckdb
import pytest

from paperloom import queries

LONG = ["a" * 49_999 + " b " + "ab c  " * 5_000, "é漢 x" * 15_000, "x" * 60_001, "x" * 65_536, " " + "é" * 50_000 + "\tlast ", "one 잇 two"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("large")
    texts = [*LONG, "first\n" + "\n".join(LONG) + "\n\nlast", "", None, "short\nlines"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, ${i + 1} AS text" for i in range(len(texts)))
    duckdb.execute(f"COPY ({rows}) TO '{path}/documents.parquet'", texts)
    return path


@pytest.mark.parametrize("name", ["hwp3_roundtrip", "docx_roundtrip"])
def test_long_lines_come_back_whole(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(folder)).select("doc_id", "ord", "heading", "digest").collect())
    assert got == sorted(con.sql(f"SELECT doc_id, ord, heading, digest FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_python_takes_few_files_at_a_time(spark):
    """One batch of files has 2 MB or so, however many there are, and the rows of small files come back together."""
    import pyarrow as pa

    from paperloom.sources import decode, samples

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(500), pa.int64()), "coarse": pa.array(["hwpml"] * 500), "content": pa.array([samples.hwpml(["x" * 9000])] * 500, pa.binary())})
    sizes = [(x.num_rows, x.nbytes) for x in decode._decode(iter([batch]))]
    assert 3 < len(sizes) < 10 and sum(n for n, _ in sizes) == 1500 and max(b for _, b in sizes) < 3 << 20

    decode.read(spark.createDataFrame([], "doc_id long, content binary")).unpersist()
    files = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 20000) AS content")

    def count(batches):
        yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])}) for b in batches)

    taken = [r.n for r in files.mapInArrow(count, "n long").collect()]
    assert sum(taken) > 40_000_000 and max(taken) < 5 << 20


def test_forms_without_rows_have_no_branch(spark):
    """Plain paragraphs need no look-up of links, notes, lists or fonts, and no tables."""
    from paperloom.plans import convert
    from paperloom.sources import decode, samples

    docs = spark.createDataFrame([(1, bytearray(samples.docx(["a", "b"], frozenset([0]))))], "doc_id long, content binary")
    rows = decode.read(docs)
    assert convert.present(rows) == {"paragraph", "style", "document"}
    found, grids = convert.blocks(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Window" not in plan and grids.count() == 0
    assert [(r.type, r.level, r.text) for r in found.orderBy("ord").collect()] == [("heading", 1, "a"), ("paragraph", None, "b")]
