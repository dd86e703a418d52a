"""Every document query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from paperloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or repr(v) == "<NA>":
            return None
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(want.columns) == columns
    assert rows(got.toPandas(), columns) == rows(want, columns)


def test_random_bytes_become_error_rows(spark):
    import random

    from paperloom.plans import convert

    r = random.Random(3)
    heads = [b"", b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"<?xml <HWPML", b"%PDF", b"HWP Document File V3.00"]
    blobs = [(i, bytearray(heads[i % len(heads)] + r.randbytes(r.randrange(700)))) for i in range(24)]
    out = convert.parse(spark.createDataFrame(blobs, "doc_id long, content binary")).collect()
    assert len(out) == 24 and not any(x.success for x in out) and all(x.code for x in out)


def test_row_spans_keep_their_columns(spark):
    from paperloom.operators import grid

    cells = [(1, 0, 0, "a", 1, 2), (1, 0, 1, "b", 2, 1), (1, 1, 0, "c", 1, 1), (1, 1, 1, "d", 1, 1), (2, 0, 0, "x", 2, 1), (2, 0, 1, "y", 1, 1)]
    df = spark.createDataFrame(cells, "t int, row_ord int, cell_ord int, text string, col_span int, row_span int")
    at = {(r.t, r.text): (r.r, r.c) for r in grid.place_cells(df, ["t"]).collect()}
    assert at == {(1, "a"): (0, 0), (1, "b"): (0, 1), (1, "c"): (1, 1), (1, "d"): (1, 2), (2, "x"): (0, 0), (2, "y"): (0, 2)}
