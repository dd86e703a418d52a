"""Tables and blocks to Markdown, as windows and ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import escape_tilde, safe_href, sanitize_text, strip


def _joined(order: list[str], value: str, sep: str) -> Column:
    """Ordered string aggregation."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value]), sep)


def gfm_cell(text: Column) -> Column:
    x = escape_tilde(sanitize_text(text))
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def carry_first_column(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, r, cells): blank ones go; a row with text in its first cell alone is withheld and fills the next row's empty first cell."""
    filled = F.filter("cells", lambda x: x != "")
    x = rows.where(F.size(filled) > 0)
    covered = F.col("covered") if "covered" in rows.columns else F.lit(False)
    x = x.withColumn("_single", (F.size(filled) == 1) & (F.col("cells")[0] != "") & ~covered)
    by = Window.partitionBy(*keys).orderBy("r")
    x = x.withColumn("_was", F.lag("_single").over(by)).withColumn("_had", F.lag(F.col("cells")[0]).over(by))
    fill = F.coalesce("_was", F.lit(False)) & (F.col("cells")[0] == "")
    x = x.withColumn("cells", F.when(fill, F.concat(F.array("_had"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))))).otherwise(F.col("cells")))
    return x.where("NOT _single").drop("_single", "_was", "_had")


def gfm_tables(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown of grids as they are, without regard to merged cells; places without a cell are blank."""
    width = F.max(F.col("c") + 1).over(Window.partitionBy(*keys))
    cells = grid.select(*keys, "r", "c", gfm_cell(F.col("text")).alias("d"), (F.col("_cols") if "_cols" in grid.columns else width).alias("_w"))
    rows = cells.groupBy(*keys, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "d"))).alias("_at"), F.first("_w").alias("_w"))
    rows = rows.select(*keys, "r", F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda c: F.coalesce(F.try_element_at("_at", c), F.lit(""))).alias("cells"))
    kept = carry_first_column(rows, keys)
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("r")) == 1
    lines = kept.select(*keys, "r", F.when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    return lines.groupBy(*keys).agg(_joined(["r"], "line", "\n").alias("markdown"))


def html_tables(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown of grids with merged cells: one HTML table each; covered cells must be gone already, places without a cell are empty ones."""
    whole = Window.partitionBy(*keys)
    x = grid.withColumn("_rows", F.max("r").over(whole) + 1).withColumn("_cols", F.max(F.col("c") + F.col("col_span")).over(whole))
    x = x.withColumn("_nth", F.row_number().over(whole.orderBy("r", "c")))
    name = F.when(F.col("r") == 0, "th").otherwise("td")
    spans = F.concat(
        F.when(F.col("col_span") > 1, F.concat(F.lit(' colspan="'), F.col("col_span"), F.lit('"'))).otherwise(""),
        F.when(F.col("row_span") > 1, F.concat(F.lit(' rowspan="'), F.col("row_span"), F.lit('"'))).otherwise(""),
    )
    body = F.replace(sanitize_text(F.col("text")), F.lit("\n"), F.lit("<br>"))
    none = F.lit(None).cast("string").alias("cell")
    cells = x.select(*keys, "r", "c", F.concat(F.lit("<"), name, spans, F.lit(">"), body, F.lit("</"), name, F.lit(">")).alias("cell"), "_cols")
    # what each merged cell covers, and every row of the table once, from its first cell
    below = x.where((F.col("col_span") > 1) | (F.col("row_span") > 1)).select(*keys, F.explode(F.sequence("r", F.least(F.col("r") + F.col("row_span"), F.col("_rows")) - 1)).alias("r"), "c", "col_span", "_cols")
    below = below.select(*keys, "r", F.explode(F.sequence("c", F.col("c") + F.col("col_span") - 1)).alias("c"), none, "_cols")
    each = x.where("_nth = 1").select(*keys, F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("r"), F.lit(None).cast("int").alias("c"), none, "_cols")
    rows = cells.unionByName(below).unionByName(each).groupBy(*keys, "r").agg(F.collect_list(F.struct("c", "cell")).alias("_at"), F.first("_cols").alias("_cols"))
    free = F.array_except(F.sequence(F.lit(0), F.col("_cols") - 1), F.transform("_at", lambda p: p["c"]))
    blank = F.concat(F.lit("<"), name, F.lit("></"), name, F.lit(">"))
    full = F.concat(F.filter("_at", lambda p: p["cell"].isNotNull()), F.transform(free, lambda c: F.struct(c.alias("c"), blank.alias("cell"))))
    rows = rows.select(*keys, "r", F.array_join(F.transform(F.array_sort(full), lambda p: p["cell"]), "").alias("row")).where("row <> ''")
    rows = rows.withColumn("row", F.concat(F.lit("<tr>"), "row", F.lit("</tr>")))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>\n"), _joined(["r"], "row", "\n"), F.lit("\n</table>")).alias("markdown"))


#: Fixed value: what counts as a formula in a line of text.
INLINE_MATH = r"(^|[^\\])\$(?=\S)(?:\\.|[^$\n])+?\S\$"


def single_cell(text: Column) -> Column:
    """A 1x1 table as structured text."""
    lines = F.filter(F.transform(F.split(sanitize_text(text), "\n"), strip), lambda x: x != "")
    shaped = F.transform(lines, lambda x: F.when(x.rlike(r"^\d+\.\s"), F.concat(F.lit("**"), escape_tilde(x), F.lit("**"))).when(x.rlike(r"^[가-힣]\.\s"), F.concat(F.lit("  "), escape_tilde(x))).otherwise(escape_tilde(x)))
    return F.array_join(shaped, "\n")


def table_markdown(grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown of grids (r, c, text, col_span, row_span) by their form; merged cells make HTML unless there is a formula in the table."""
    whole = Window.partitionBy(*keys)
    x = grid.withColumn("_rows", F.max("r").over(whole) + 1).withColumn("_cols", F.max(F.col("c") + F.col("col_span")).over(whole))
    x = x.withColumn("_merged", F.max(((F.col("col_span") > 1) | (F.col("row_span") > 1)).cast("int")).over(whole) == 1)
    x = x.withColumn("_merged", F.col("_merged") & ~F.max(F.col("text").rlike(INLINE_MATH)).over(whole))
    one = (F.col("_rows") == 1) & (F.col("_cols") == 1)
    drop = ["_rows", "_merged"]
    html = html_tables(x.where("_merged").drop(*drop, "_cols"), keys)
    single = x.where(~F.col("_merged") & one).select(*keys, single_cell(F.col("text")).alias("markdown"))
    column = x.where(~F.col("_merged") & ~one & (F.col("_cols") == 1) & (F.col("text") != ""))
    column = column.select(*keys, "r", F.replace(escape_tilde(sanitize_text(F.col("text"))), F.lit("\n"), F.lit(" ")).alias("line")).groupBy(*keys).agg(_joined(["r"], "line", "\n").alias("markdown"))
    plain = gfm_tables(x.where(~F.col("_merged") & (F.col("_cols") > 1)).drop(*drop), keys)
    return html.unionByName(single).unionByName(column).unionByName(plain)


def fuse_attachments(blocks: DataFrame, key: str) -> DataFrame:
    """Adds ``fused``: the text of the next block where this one and it make one attachment heading, and drops that block.

    A heading takes the block after it even if that could begin a pair itself, so inside a run of
    candidates the odd ones fuse.
    """
    by = Window.partitionBy(key).orderBy("ord")
    begins = (F.col("type") == "paragraph") & sanitize_text(F.coalesce("text", F.lit(""))).rlike(r"^\[별표\s*\d+")
    ends = (F.lead("type").over(by) == "paragraph") & F.coalesce(F.lead("text").over(by), F.lit("")).rlike(r"관련\)?$")
    x = blocks.withColumn("_cand", F.coalesce(begins & ends, F.lit(False))).withColumn("_next", F.lead("text").over(by))
    x = x.withColumn("_island", F.sum(F.when(F.col("_cand"), 0).otherwise(1)).over(by))
    nth = F.sum(F.when(F.col("_cand"), 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy("ord"))
    x = x.withColumn("_fuses", F.col("_cand") & (nth % 2 == 1)).withColumn("fused", F.when(F.col("_fuses"), F.col("_next")))
    gone = F.coalesce(F.lag("_fuses").over(by), F.lit(False))
    return x.withColumn("_gone", gone).where("NOT _gone").drop("_cand", "_next", "_island", "_fuses", "_gone")


def image_runs(blocks: DataFrame, key: str) -> DataFrame:
    """Image blocks that follow each other on one page as one block, its texts as Markdown joined by a space."""
    by = Window.partitionBy(key).orderBy("ord")
    image = (F.col("type") == "image") & (F.coalesce("text", F.lit("")) != "")
    x = blocks.withColumn("_image", image)
    same = F.col("_image") & F.coalesce(F.lag("_image").over(by), F.lit(False)) & F.lag("page_number").over(by).eqNullSafe(F.col("page_number"))
    x = x.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(by))
    run = Window.partitionBy(key, "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = F.array_join(F.collect_list(F.concat(F.lit("![image]("), F.col("text"), F.lit(")"))).over(run), " ")
    x = x.withColumn("text", F.when(F.col("_image"), links).otherwise(F.col("text"))).withColumn("_same", same)
    return x.where("NOT _same").drop("_image", "_run", "_same")


def blocks_to_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """key, markdown.  ``blocks``: key, ord, type, text, level, page_number, list_type, href, footnote_text, and markdown of tables.

    A paragraph of list_type ``verbatim`` is shown as it is.
    """
    as_is = F.coalesce((F.col("type") == "paragraph") & (F.col("list_type") == "verbatim"), F.lit(False))
    x = image_runs(fuse_attachments(blocks.withColumn("type", F.when(as_is, "verbatim").otherwise(F.col("type"))), key), key)
    t = sanitize_text(F.coalesce("text", F.lit("")))
    x = x.withColumn("t", F.when(F.col("type") == "image", F.coalesce("text", F.lit(""))).otherwise(t))
    full = F.col("t") != ""
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(2)), F.lit(6))), F.lit(" "), F.col("t"))
    numbered = (F.col("list_type") == "ordered") & F.col("t").rlike(r"^\d+\.\s")
    item = F.concat(F.when(numbered, "").when(F.col("list_type") == "ordered", "1. ").otherwise("- "), F.col("t"))
    href = safe_href(F.col("href"))
    linked = F.when(href.isNotNull(), F.concat(F.lit("["), F.col("t"), F.lit("]("), href, F.lit(")"))).otherwise(F.col("t"))
    noted = F.concat(linked, F.when(F.coalesce("footnote_text", F.lit("")) != "", F.concat(F.lit(" (주: "), F.col("footnote_text"), F.lit(")"))).otherwise(""))
    around = lambda c: F.array(F.lit(""), c, F.lit(""))
    kind = F.col("type")
    lines = (
        F.when((kind == "heading") & full, around(heading))
        .when((kind == "image") & full, around(F.col("t")))
        .when(kind == "separator", around(F.lit("---")))
        .when((kind == "list") & full, F.array(item))
        .when((kind == "paragraph") & F.col("fused").isNotNull(), around(F.concat(F.lit("## "), F.col("t"), F.lit(" "), F.col("fused"))))
        .when((kind == "paragraph") & F.col("t").rlike(r"^\[별표\s*\d+"), around(F.concat(F.lit("## "), F.col("t"))))
        .when((kind == "paragraph") & F.col("t").rlike(r"^\([^)]*조[^)]*관련\)$"), F.array(F.concat(F.lit("*"), F.col("t"), F.lit("*")), F.lit("")))
        .when((kind == "paragraph") & full, F.array(escape_tilde(noted), F.lit("")))
        .when((kind == "verbatim") & (F.coalesce("text", F.lit("")) != ""), F.array(F.col("text"), F.lit("")))
        .when((kind == "table") & (F.coalesce("markdown", F.lit("")) != ""), F.array(F.col("markdown"), F.lit("")))
    )
    x = x.withColumn("lines", lines).where(F.col("lines").isNotNull())
    # only a list item leaves its line without a blank one behind it
    by = Window.partitionBy(key).orderBy("ord")
    after_item = (kind == "table") & (F.lag("type").over(by) == "list")
    x = x.withColumn("lines", F.when(F.coalesce(after_item, F.lit(False)), F.concat(F.array(F.lit("")), F.col("lines"))).otherwise(F.col("lines")))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "lines"))), lambda b: b["lines"]))
    return x.groupBy(key).agg(strip(F.array_join(whole, "\n")).alias("markdown"))


def flatten_layout_tables(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, cells of the other tables): tables of few rows and much text are layout, and their lines paragraphs."""
    whole = Window.partitionBy(*keys)
    rows, cols = F.max("r").over(whole) + 1, F.max("c").over(whole) + 1
    newlines = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).over(whole)
    x = cells.withColumn("_rows", rows).withColumn("_cols", cols).withColumn("_nl", newlines).withColumn("_len", F.sum(F.length("text")).over(whole))
    layout = ~((F.col("_rows") == 1) & (F.col("_cols") == 1)) & (F.col("_rows") <= 3) & ((F.col("_nl") > 5) | ((F.col("_rows") <= 2) & (F.col("_len") > 300)))
    drop = ["_rows", "_cols", "_nl", "_len"]
    lines = x.where(layout).select(*keys, "r", "c", F.posexplode(F.split(strip(F.col("text")), "\n")).alias("i", "line"))
    return lines.select(*keys, "r", "c", "i", strip(F.col("line")).alias("text")).where("text <> ''"), x.where(~layout).drop(*drop)
