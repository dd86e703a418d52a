"""From tagged rows to blocks, Markdown and results."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import clean_numeric, error_code, page_list, page_set, strip
from paperloom.operators import classify, grid, render
from paperloom.sources import decode

TABLE = ["doc_id", "section", "ord"]
BLOCK = ["doc_id", "section", "ord", "type", "text", "level", "page_number", "list_type", "href", "footnote_text", "font_size", "font_name", "bold", "italic"]


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _blocks(df: DataFrame, more: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    null = F.lit(None)
    kinds = {"level": "int", "page_number": "int", "font_size": "double", "bold": "boolean", "italic": "boolean"}
    return df.select(*[(columns.get(c, F.col(c) if c in ("doc_id", "section", "ord", "text") else null)).cast(kinds.get(c, "int" if c == "section" else "long" if c in ("doc_id", "ord") else "string")).alias(c) for c in BLOCK], *more)


def present(rows: DataFrame) -> frozenset[str]:
    """The kinds of rows that there are; of cells their forms.

    One pass decodes and keeps all rows; what later branches read is then in a known place, and branches without rows are left out.
    """
    cell = F.when(_attr("type").isNotNull(), "sheet").when(_attr("flow").isNotNull(), "flow").when(_attr("placed").isNotNull(), "placed").otherwise("raw")
    form = F.when(F.col("kind") == "cell", cell).when(F.col("kind") == "sheet", "name").otherwise(F.col("kind"))
    return frozenset(r[0] for r in rows.select(form).distinct().collect())


def sheet_cells(rows: DataFrame) -> DataFrame:
    """doc_id, section, r, c, text of spreadsheet cells: shared strings looked up, booleans and numbers as text."""
    strings = rows.where("kind = 'string'").select("doc_id", F.col("ord").alias("idx"), F.col("text").alias("shared"))
    cells = rows.where((F.col("kind") == "cell") & _attr("type").isNotNull()).select("doc_id", "section", "r", "c", "text", _attr("type").alias("type"), _attr("formula").alias("formula"))
    index = F.when((F.col("type") == "s") & F.col("text").rlike(r"^\d+$"), F.col("text").cast("long"))
    x = cells.withColumn("idx", index).join(strings, ["doc_id", "idx"], "left")
    value = F.when(F.col("type") == "s", F.coalesce("shared", F.lit(""))).when(F.col("type") == "b", F.when(F.col("text") == "1", "TRUE").otherwise("FALSE"))
    value = value.when(F.col("type").isin("inlineStr", "str", "e"), F.coalesce("text", F.lit(""))).when(F.col("text").isNotNull(), clean_numeric(F.col("text")))
    formula = F.when(F.coalesce("formula", F.lit("")) != "", F.concat(F.lit("="), F.col("formula")))
    return x.select("doc_id", "section", "r", "c", F.coalesce(value, formula, F.lit("")).alias("text"))


def sheet_grids(rows: DataFrame) -> DataFrame:
    """TABLE, r, c, text, col_span, row_span of each sheet: dense, blank rows at both ends trimmed, merges resolved."""
    keys = ["doc_id", "section"]
    cells = sheet_cells(rows)
    extent = cells.groupBy(*keys).agg(F.min(F.when(F.col("text") != "", F.col("r"))).alias("r1"), F.max(F.when(F.col("text") != "", F.col("r"))).alias("r2"), F.max("c").alias("c2")).where("r1 IS NOT NULL")
    # the limit counts from the first row that has text
    extent = extent.withColumn("r2", F.least("r2", F.col("r1") + grid.MAX_ROWS - 1))
    dense = extent.select(*keys, F.explode(F.sequence("r1", "r2")).alias("r"), "c2").select(*keys, "r", F.explode(F.sequence(F.lit(0), F.col("c2"))).alias("c"))
    full = dense.join(cells, [*keys, "r", "c"], "left").select(*keys, "r", "c", F.coalesce("text", F.lit("")).alias("text"))
    merges = rows.where("kind = 'merge'").select(*keys, *[_attr(k).cast("int").alias(k) for k in ("r1", "c1", "r2", "c2")])
    done = grid.resolve_merges(full, merges, keys)
    first = F.min("r").over(Window.partitionBy(*keys))
    return grid.trim_columns(done.withColumn("r", (F.col("r") - first).cast("int")), keys).withColumn("ord", F.lit(1).cast("long"))


def _spanned(rows: DataFrame, flow: bool) -> DataFrame:
    cells = rows.where((F.col("kind") == "cell") & _attr("span").isNotNull() & (_attr("flow").isNotNull() if flow else _attr("flow").isNull()))
    return cells.withColumn("col_span", F.coalesce(_attr("span").cast("int"), F.lit(1)))


_GRID = [*TABLE, "r", "c", "text", "col_span", "row_span"]


_NO_GRID = "doc_id long, section int, ord long, r int, c int, text string, col_span int, row_span int"


def placed_grids(rows: DataFrame) -> DataFrame:
    """The same of the tables in text documents whose cells say where they stand."""
    at = _spanned(rows, flow=False).where(_attr("placed").isNotNull()).withColumn("row_span", F.coalesce(_attr("rows").cast("int"), F.lit(1)))
    placed = grid.place_directly(at.select(*_GRID, _attr("i").cast("int").alias("i"), _attr("lines").cast("int").alias("n_rows")), TABLE).select(*_GRID)
    return grid.trim_columns(placed, TABLE)


def raw_grids(rows: DataFrame) -> DataFrame:
    """The same of those whose cells follow each other."""
    cells = _spanned(rows, flow=False)
    said = F.coalesce(_attr("rows").cast("int"), F.lit(1))
    raw = cells.where(_attr("placed").isNull()).withColumnRenamed("r", "row_ord").withColumnRenamed("c", "cell_ord")
    merged = grid.vertical_runs(raw, TABLE, (_attr("merge").isNotNull()) & (_attr("merge") != "restart"))
    merged = merged.withColumn("row_span", F.greatest("row_span", said))  # vertical runs, or spans that cells give
    flowed = grid.place_cells(merged.select(*TABLE, "row_ord", "cell_ord", "text", "col_span", "row_span"), TABLE).select(*_GRID)
    return grid.trim_columns(flowed, TABLE)


def flowing_grids(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of text, grids) of the tables that may be layout; one whose cells give their places keeps its blank columns."""
    cells = _spanned(rows, flow=True).withColumn("row_span", F.coalesce(_attr("rows").cast("int"), F.lit(1))).withColumn("_whole", _attr("whole").isNotNull())
    last = F.max(F.when((strip(F.col("text")) != "") | F.col("_whole"), F.col("c"))).over(Window.partitionBy(*TABLE))
    cells = cells.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("c") <= F.col("_last"))).select(*_GRID)
    lines, kept = render.flatten_layout_tables(cells, TABLE)
    nth = F.row_number().over(Window.partitionBy(*TABLE).orderBy("r", "c", "i"))
    return lines.select("doc_id", "section", (F.col("ord") + nth).alias("ord"), "text"), kept


def text_blocks(rows: DataFrame, files: DataFrame, found: frozenset[str]) -> DataFrame:
    p = rows.where("kind = 'paragraph'").join(files, "doc_id")
    # what no row has is known to be empty, and the planner leaves out its join
    some = lambda kind: rows.where(F.col("kind") == kind if kind in found else F.lit(False))
    of = lambda kind, *names: some(kind).select("doc_id", *[_attr(n).alias(f"{kind}_{n}") for n in names], F.col("text").alias(f"{kind}_text"))
    x = p.select("doc_id", "section", "ord", "text", "file_type", *[_attr(n).alias(n) for n in ("style", "outline", "num", "ilvl", "link", "note", "char", "plain", "rule")])
    x = x.join(of("style", "id", "outline").dropDuplicates(["doc_id", "style_id"]).withColumnRenamed("style_id", "style"), ["doc_id", "style"], "left")
    x = x.join(of("rel", "id").withColumnRenamed("rel_id", "link"), ["doc_id", "link"], "left")
    x = x.join(of("note", "id").withColumnRenamed("note_id", "note"), ["doc_id", "note"], "left")
    # a paragraph has one character shape, or the most frequent one of its runs
    runs = grid.dominant_value(some("shape").select(*TABLE, "r", F.col("text").alias("_run")), TABLE, "_run", "r")
    x = x.join(runs, TABLE, "left").withColumn("char", F.coalesce("char", "_run"))
    x = x.join(of("char", "id", "size", "face", "bold", "italic").drop("char_text").withColumn("char", F.col("char_id")), ["doc_id", "char"], "left")
    formats = some("numbering").select("doc_id", _attr("num").alias("num"), _attr("ilvl").alias("ilvl"), _attr("fmt").alias("fmt"))
    x = classify.list_kind(formats, x, ["doc_id", "num", "ilvl"])
    level = F.coalesce(F.col("outline"), F.col("style_outline")).cast("int")
    docx = F.when(level.between(0, 5), level + 1)
    hwpml = F.when(level.isNotNull(), F.least(F.greatest(level, F.lit(0)) + 1, F.lit(6)))
    level = F.when(F.col("file_type") == "docx", docx).when(F.col("file_type") == "hwpml", hwpml).when(F.col("file_type") == "hwp", level)
    listed = F.col("num").isNotNull() & (F.col("num") != "0")
    kind = F.when(level.isNotNull(), "heading").when(listed, "list").otherwise("paragraph")
    list_type = F.when(F.col("plain").isNotNull(), "verbatim").when(listed, F.col("list_type"))
    page = F.when(~F.col("file_type").isin("docx", "hwp3"), F.col("section") + 1)
    x = x.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("file_type", F.coalesce("rule", "file_type"))
    return _blocks(x, ("file_type",), type=kind, level=level, page_number=page, list_type=list_type, href=F.col("rel_text"), footnote_text=F.col("note_text"), font_size=F.col("char_size"), font_name=F.col("char_face"), **{c: F.when(F.col("char_id").isNotNull(), F.col(f"char_{c}").isNotNull()) for c in ("bold", "italic")})


def blocks(rows: DataFrame, found: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, grids); ``found`` are the forms of rows that there can be."""
    found = present(rows) if found is None else found
    files = rows.where("kind = 'document'").select("doc_id", F.col("text").alias("file_type"))
    parts, tables = [], [make(rows) for form, make in (("sheet", sheet_grids), ("placed", placed_grids), ("raw", raw_grids)) if form in found]
    # one page number of a sheet or section, so a block's place is (section, ord)
    page = F.col("section") + 1
    texts = [text_blocks(rows, files, found)] if "paragraph" in found else []
    if "name" in found:
        parts.append(_blocks(rows.where("kind = 'sheet' AND text <> ''"), type=F.lit("heading"), level=F.lit(2), page_number=page))
    if "flow" in found:
        lines, flowing = flowing_grids(rows)
        tables.append(flowing)
        # a layout table's lines are paragraphs behind its place
        texts.append(_blocks(lines, type=F.lit("paragraph"), page_number=page).withColumn("file_type", F.lit("hwp")))
    if tables:
        # read once for the table blocks and once for each form of rendering
        grids = reduce(DataFrame.unionByName, tables).persist(StorageLevel.MEMORY_AND_DISK)
        parts.append(_blocks(grids.select(*TABLE).distinct().withColumn("text", F.lit(None).cast("string")), type=F.lit("table"), page_number=page))
    else:
        grids = rows.sparkSession.createDataFrame([], _NO_GRID)
    if texts:
        bases = body_sizes(rows) if "named_style" in found else None
        parts.append(classify.with_headings(reduce(DataFrame.unionByName, texts), bases, "doc_id", "char" in found).select(*BLOCK))
    if "image" in found:
        parts.append(image_blocks(rows))
    if not parts:
        parts.append(_blocks(rows.where(F.lit(False))))
    return reduce(DataFrame.unionByName, parts), grids


#: Parts of the names that a body text's style has.
BODY_STYLES = ("바탕", "본문", "normal", "body")


def body_sizes(rows: DataFrame) -> DataFrame:
    """doc_id, base: the font size of the first style named for body text."""
    named = rows.where("kind = 'named_style'").where(F.col("text").rlike("|".join(BODY_STYLES))).select("doc_id", "ord", _attr("char").alias("char"))
    sizes = rows.where("kind = 'char'").select("doc_id", _attr("id").alias("char"), _attr("size").cast("double").alias("size")).where("size > 0")
    return named.join(sizes, ["doc_id", "char"]).groupBy("doc_id").agg(F.min_by("size", "ord").alias("base"))


#: The first bytes of each image type.
MAGIC = {"image/png": "89504E47", "image/jpeg": "FFD8FF", "image/gif": "474946", "image/bmp": "424D", "image/wmf": "D7CDC69A", "image/emf": "01000000"}


def images(rows: DataFrame) -> DataFrame:
    """doc_id, section, ord, name, mime_type, filename, apart, data of the images; those of no known type have no mime_type."""
    head, mime = F.hex(F.substring("data", 1, 4)), _attr("mime")
    for kind, magic in MAGIC.items():
        mime = F.coalesce(mime, F.when(head.startswith(magic), kind))
    x = rows.where("kind = 'image'").select("doc_id", "section", "ord", F.col("text").alias("name"), F.when(F.length("data") > 0, mime).alias("mime_type"), _attr("ext").alias("ext"), _attr("apart").isNotNull().alias("apart"), "data")
    known = F.col("mime_type").isNotNull()
    nth = F.sum(known.cast("int")).over(Window.partitionBy("doc_id").orderBy("section", "ord"))
    ext = F.coalesce("ext", F.when(F.col("mime_type") == "image/jpeg", "jpg").otherwise(F.element_at(F.split("mime_type", "/"), -1)))
    number = F.when(nth < 1000, F.lpad(nth.cast("string"), 3, "0")).otherwise(nth.cast("string"))
    return x.withColumn("filename", F.when(known, F.concat(F.lit("image_"), number, F.lit("."), ext))).drop("ext")


def image_blocks(rows: DataFrame) -> DataFrame:
    """An image block for each image, and a paragraph for each that can't be shown."""
    x = images(rows).drop("data").where("NOT apart")
    text = F.coalesce("filename", F.concat(F.lit("[이미지: "), F.col("name"), F.lit("]")))
    return _blocks(x.withColumn("text", text), type=F.when(F.col("filename").isNotNull(), "image").otherwise("paragraph"), page_number=F.col("section") + 1)


def metadata(rows: DataFrame) -> DataFrame:
    """doc_id, title, author, created_at, modified_at, page_count, version, description, keywords of each document."""
    said = rows.where("kind IN ('meta', 'document')").withColumn("_name", _attr("name"))
    first = lambda name: F.min_by(F.when(F.col("_name") == name, F.col("text")), F.when(F.col("_name") == name, F.col("ord")))
    fields = [first(n).alias(n) for n in ("title", "author", "created_at", "modified_at")]
    words = F.transform(F.sort_array(F.collect_list(F.when(F.col("_name") == "keyword", F.struct("ord", "text")))), lambda x: x["text"])
    return said.groupBy("doc_id").agg(*fields, first("page_count").cast("int").alias("page_count"), first("version").alias("version"), first("description").alias("description"), words.alias("keywords"))


def outline(found: DataFrame) -> DataFrame:
    """The headings of blocks: doc_id, section, ord, level, text, page_number."""
    return classify.outline(found).select(*TABLE, "level", "text", "page_number")


def warnings(rows: DataFrame) -> DataFrame:
    """doc_id, page, code, message."""
    said = rows.where("kind = 'warning'").select("doc_id", (F.col("section") + 1).alias("page"), _attr("code").alias("code"), F.col("text").alias("message"))
    lost = images(rows).where("filename IS NULL").select("doc_id", (F.col("section") + 1).alias("page"), F.lit("SKIPPED_IMAGE").alias("code"), F.concat(F.lit("이미지를 읽을 수 없음: "), F.col("name")).alias("message"))
    return said.unionByName(lost)


#: Row kinds that belong to one section, and the formats that have any.
_IN_SECTION = ("paragraph", "cell", "merge", "sheet", "shape", "image", "warning")
_SECTIONED = ("xlsx", "xls", "hwp", "hwpx", "hwpml")


def select_pages(rows: DataFrame, pages: str | list[float] | None) -> DataFrame:
    """The rows of the sheets or sections that ``pages`` names (such as 1,3,5-7, or a list of numbers); if it selects none, all."""
    if not pages:
        return rows
    chosen = (lambda n: page_set(F.lit(pages), n)) if isinstance(pages, str) else (lambda n: page_list(F.lit([float(x) for x in pages]), n))
    count = F.coalesce(F.max(F.when((F.col("kind") == "meta") & (_attr("name") == "page_count"), F.col("text").cast("int"))), F.max("section") + 1)
    kind = F.max(F.when(F.col("kind") == "document", F.col("text")))
    wanted = rows.groupBy("doc_id").agg(count.alias("_n"), kind.alias("_kind")).where(F.col("_kind").isin(*_SECTIONED))
    wanted = wanted.select("doc_id", chosen(F.col("_n")).alias("_pages")).where(F.size("_pages") > 0)
    keep = F.col("_pages").isNull() | ~F.col("kind").isin(*_IN_SECTION) | F.array_contains("_pages", F.col("section") + 1)
    return rows.join(wanted, "doc_id", "left").where(keep).drop("_pages")


def results(rows: DataFrame) -> DataFrame:
    """One row for each document: doc_id, success, file_type, markdown, page_count, error, code."""
    return _results(rows, *blocks(rows))


def _results(rows: DataFrame, found: DataFrame, grids: DataFrame) -> DataFrame:
    tables = render.table_markdown(grids, TABLE)
    # sections come one after another: a document's order is (section, ord)
    place = F.col("section").cast("long") * (1 << 40) + F.col("ord")
    marked = found.join(tables, TABLE, "left").withColumn("ord", place)
    markdown = render.blocks_to_markdown(marked, "doc_id")
    pages = F.max(F.when((F.col("kind") == "meta") & (_attr("name") == "page_count"), F.col("text").cast("int")))
    error = F.max(F.when(F.col("kind") == "error", F.struct("text", _attr("code").alias("code"))))
    docs = rows.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "document", F.col("text"))).alias("file_type"), pages.alias("page_count"), error.alias("e"))
    out = docs.join(markdown, "doc_id", "left")
    failed = F.col("e").isNotNull()
    return out.select(
        "doc_id", (~failed).alias("success"), "file_type",
        F.when(~failed, F.coalesce("markdown", F.lit(""))).alias("markdown"),
        F.when(~failed, F.col("page_count")).alias("page_count"),
        F.col("e.text").alias("error"),
        F.when(failed, F.coalesce("e.code", error_code(F.col("e.text")))).alias("code"),
    )


def parse(docs: DataFrame, pages: str | list[float] | None = None) -> DataFrame:
    """The results of documents (doc_id, content), of all or of the chosen sheets or sections."""
    return Conversion(docs, pages).results()


class Conversion:
    """The conversion of documents (doc_id, content) and what it keeps while it is read: use it as a context to let that go again."""

    def __init__(self, docs: DataFrame, pages: str | list[float] | None = None):
        self.decoded = decode.read(docs)
        self.rows = select_pages(self.decoded, pages)
        self.blocks, self.grids = blocks(self.rows, present(self.decoded))

    def results(self) -> DataFrame:
        return _results(self.rows, self.blocks, self.grids)

    def __enter__(self) -> Conversion:
        return self

    def __exit__(self, *_: object) -> None:
        self.grids.unpersist()
        self.decoded.unpersist()


def to_json(found: DataFrame, said: DataFrame) -> DataFrame:
    """doc_id and the JSON text of each result, with the warnings ``said`` (doc_id, page, code, message)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page", "code", "message"))), lambda w: F.struct(w["message"].alias("message"), w["code"].alias("code"), w["page"].alias("page")))
    x = found.join(said.groupBy("doc_id").agg(listed.alias("warnings")), "doc_id", "left")
    none = F.slice(F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("message", "string"), ("code", "string"), ("page", "int"))])), 1, 0)
    fields = F.struct("file_type", "markdown", "page_count", F.coalesce("warnings", none).alias("warnings"))
    return x.select("doc_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))
