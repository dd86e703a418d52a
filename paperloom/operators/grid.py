"""Placing cells in grids, merged ranges, and the form of tables.

Every table here is keyed by the columns ``keys`` (a document and a table in it), so all
windows and aggregates of one query share one partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import strip

MAX_ROWS, MAX_COLS = 10_000, 200


def column_positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``c`` of each cell where no cell spans rows: the spans before it in its row."""
    before = Window.partitionBy(*keys, "row_ord").orderBy("cell_ord").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("c", F.coalesce(F.sum("col_span").over(before), F.lit(0)).cast("int"))


def place_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c, text, col_span, row_span of raw cells (row_ord, cell_ord, text, spans).

    A cell takes its row's first free column; a cell that spans rows keeps its columns from the
    rows below.  That is a scan of one table, which is bounded, so tables with row spans
    go through Python by table and all others through a window.
    """
    spans = F.max("row_span").over(Window.partitionBy(*keys))
    marked = cells.where(F.col("row_ord") < MAX_ROWS).withColumn("_most", spans)
    out = [*keys, "r", "c", "text", "col_span", "row_span"]
    flat = column_positions(marked.where("_most <= 1"), keys).withColumn("r", F.col("row_ord").cast("int")).select(*out)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in keys), "r int", "c int", "text string", "col_span int", "row_span int"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_ord", "cell_ord"])
        taken: dict[int, int] = {}  # column -> first row that it is free again in
        rows = []
        for row, group in pdf.groupby("row_ord", sort=True):
            c = 0
            for x in group.itertuples(index=False):
                while taken.get(c, -1) > row:
                    c += 1
                rows.append((*(getattr(x, k) for k in keys), int(row), c, x.text, int(x.col_span), int(x.row_span)))
                for j in range(c, min(c + int(x.col_span), MAX_COLS)):
                    taken[j] = int(row) + int(x.row_span)
                c += int(x.col_span)
        return pd.DataFrame(rows, columns=out)

    return flat.unionByName(marked.where("_most > 1").drop("_most").groupBy(*keys).applyInPandas(scan, schema)).where(F.col("c") < MAX_COLS)


def place_directly(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c, text, col_span, row_span of cells that say where they stand (i, n_rows, r, c, text, spans).

    Cells are written in the order of ``i``, each over all of its range: of two that meet the later one stays.  What
    lies below a cell that is still there is no cell; what a lost cell covered is empty.
    """
    width = F.least(F.max(F.col("c") + F.col("col_span")).over(Window.partitionBy(*keys)), F.lit(MAX_COLS))
    x = cells.withColumn("_width", width).where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("n_rows")) & (F.col("c") < F.col("_width")))
    down = x.withColumn("_r", F.explode(F.sequence("r", F.least(F.col("r") + F.col("row_span"), F.col("n_rows")) - 1)))
    at = down.withColumn("_c", F.explode(F.sequence("c", F.least(F.col("c") + F.col("col_span"), F.col("_width")) - 1)))
    at = at.withColumn("_anchor", (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")))
    place, cell = Window.partitionBy(*keys, "_r", "_c"), Window.partitionBy(*keys, "i")
    at = at.withColumn("_wins", F.col("i") == F.max("i").over(place))
    at = at.withColumn("_stays", F.max(F.col("_anchor") & F.col("_wins")).over(cell))
    at = at.withColumn("_covered", F.max(~F.col("_anchor") & F.col("_stays")).over(place)).where("_wins AND NOT _covered")
    value = lambda c, other: F.when(F.col("_anchor"), F.col(c)).otherwise(other).alias(c)
    return at.select(*keys, F.col("_r").cast("int").alias("r"), F.col("_c").cast("int").alias("c"), value("text", ""), value("col_span", 1), value("row_span", 1))


def footprints(merges: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of each merged range (r1, c1, r2, c2), and whether it is the range's anchor."""
    rows = merges.select(*keys, "r1", "c1", "r2", "c2", F.explode(F.sequence("r1", "r2")).alias("r"))
    return rows.select(*keys, "r", F.explode(F.sequence("c1", "c2")).alias("c"), "r1", "c1", "r2", "c2").withColumn("anchor", (F.col("r") == F.col("r1")) & (F.col("c") == F.col("c1")))


def resolve_merges(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, r, c, text) without those that a range covers; anchors carry its spans."""
    at = footprints(merges, keys)
    covered = at.where("NOT anchor").select(*keys, "r", "c").distinct()
    anchors = at.where("anchor").groupBy(*keys, "r", "c").agg(F.max_by(F.struct((F.col("c2") - F.col("c1") + 1).alias("cs"), (F.col("r2") - F.col("r1") + 1).alias("rs")), F.struct("r2", "c2")).alias("s"))
    kept = cells.join(covered, [*keys, "r", "c"], "left_anti").join(anchors, [*keys, "r", "c"], "left")
    return kept.select(*cells.columns, F.coalesce("s.cs", F.lit(1)).alias("col_span"), F.coalesce("s.rs", F.lit(1)).alias("row_span"))


def trim_columns(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Without the columns after the last one that has any text; a blank table stays whole."""
    last = F.max(F.when(strip(F.col("text")) != "", F.col("c"))).over(Window.partitionBy(*keys))
    return grid.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("c") <= F.col("_last"))).drop("_last")


def vertical_runs(cells: DataFrame, keys: list[str], continues: Column) -> DataFrame:
    """Cells that begin a vertical merge, with the length of the run below as row_span."""
    down = Window.partitionBy(*keys, "cell_ord").orderBy("row_ord")
    marked = cells.withColumn("_c", F.coalesce(continues, F.lit(False)))
    run = F.sum(F.when(F.col("_c"), 0).otherwise(1)).over(down)
    sized = marked.withColumn("_run", run).withColumn("row_span", F.count("*").over(Window.partitionBy(*keys, "cell_ord", "_run")).cast("int"))
    return sized.where("NOT _c").drop("_c", "_run")


def dominant_value(values: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equal ones that which reaches the count first, then the smaller one."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_last").alias("at"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.v").alias(value))
