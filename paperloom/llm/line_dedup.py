"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites that show it; sketches merge by
aggregation.  A line clearly above the threshold is boilerplate, and for a line whose
estimate lies within three standard errors of it the distinct sites are counted exactly.  Every line that
has a word counts, however short: its spread alone decides.  Boilerplate is removed
from all documents but the first that has it, by row and line number, so that a text
which many sites copied is never lost as a whole.

A row is known by its doc_id and its text's hash.  Rows that share a doc_id are judged each by its
own text; only those that share the text too are alike, and lose the same lines.

Defined cases: a null text is empty, and stays null; a null site counts as none; blank lines always stay;
a null doc_id comes after all others and is cut like them; of rows that repeat a doc_id the one whose text has the smaller hash
comes first; an empty table gives an empty result; extra columns are kept, whatever their names, but for
n_lines and n_lines_removed, which the result sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._session import materialize

MIN_SITES = 10
LG_K = 12
_BLANKS = " \t\n\x0b\x0c\r"


def _row(id_col: str, text_col: str) -> Column:
    """What a row is known by, in the order of rows."""
    return F.struct(F.col(f"`{id_col}`").isNull().alias("unnamed"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    site = F.when(F.col(f"`{site_col}`").isNotNull(), F.xxhash64(F.col(f"`{site_col}`")))
    x = docs.select(_row(id_col, text_col).alias("row"), site.alias("site"), F.posexplode(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")).alias("pos", "line"))
    x = x.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where(F.col("line") != "")
    return x.select("row", "pos", F.xxhash64("line").alias("h"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h and first (row, pos) of each line hash that at least ``min_sites`` sites show."""
    error = 3 * 1.04 / math.sqrt(1 << LG_K)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    spread = lines.groupBy("h").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
        F.min(F.struct("row", "pos")).alias("first"),
    )
    spread = materialize(spread.select("h", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("h")
    # pairs first, so that a line which a third of all rows show is a row for each site
    exact = lines.select("h", "site").distinct().join(near, "h", "left_semi").groupBy("h").agg(F.count("site").alias("exact"))
    known = spread.join(materialize(exact), "h", "left")
    return materialize(known.where(F.coalesce("exact", "sites") >= min_sites).select("h", "first"))


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(columns of ``docs`` as the struct ``row``, text, n_lines, n_lines_removed): each row with boilerplate lines cut from its text."""
    lines = materialize(_lines(docs, id_col, text_col, site_col))
    found = lines.join(boilerplate(lines, min_sites), "h").where(F.struct("row", "pos") != F.col("first"))
    gone = found.groupBy("row").agg(F.collect_set("pos").alias("_gone")).select(F.col("row").alias("_key"), "_gone")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{text_col}`").alias("text"), _row(id_col, text_col).alias("_own"))
    x = marked.join(gone, F.col("_own").eqNullSafe(F.col("_key")), "left")
    x = x.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.col("_lines")[i])
    return x.select(
        "row",
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_lines_removed"),
    )


def dedup_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and n_lines and n_lines_removed beside its columns."""
    x = cut_documents(docs, text_col=text_col, **options)
    own = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    return x.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own], "n_lines", "n_lines_removed")
