"""One document at a time, as Python objects; many at once are better served by `paperloom.plans.convert`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2.0"

FileType = Literal["hwp", "hwp3", "hwpx", "hwpml", "xlsx", "xls", "docx", "pdf", "unknown"]


class ConversionError(Exception):
    """A document that can't be converted, with a message for users."""


@dataclass
class CellContext:
    """A cell as its file has it: where it says that it stands, if it does."""

    text: str
    col_span: int = 1
    row_span: int = 1
    col_addr: int | None = None
    row_addr: int | None = None


@dataclass
class IRCell:
    text: str
    col_span: int = 1
    row_span: int = 1


@dataclass
class IRTable:
    rows: int
    cols: int
    cells: list[list[IRCell]]
    has_header: bool


@dataclass
class InlineStyle:
    bold: bool | None = None
    italic: bool | None = None
    font_size: float | None = None
    font_name: str | None = None


@dataclass
class IRBlock:
    type: str
    text: str | None = None
    table: IRTable | None = None
    level: int | None = None
    page_number: int | None = None
    style: InlineStyle | None = None
    list_type: str | None = None
    href: str | None = None
    footnote_text: str | None = None


@dataclass
class DocumentMetadata:
    title: str | None = None
    author: str | None = None
    creator: str | None = None
    created_at: str | None = None
    modified_at: str | None = None
    page_count: int | None = None
    version: str | None = None
    description: str | None = None
    keywords: list[str] | None = None


@dataclass
class ParseOptions:
    """``pages`` chooses sheets or sections.

    ``on_progress`` is told (done, all) before and after the conversion.  ``ocr``, ``formula_ocr`` and
    ``remove_header_footer`` concern PDF pages alone, which are no supported input; ``file_path`` is for messages.
    """

    pages: list[int] | str | None = None
    ocr: Callable | None = None
    on_progress: Callable[[int, int], None] | None = None
    remove_header_footer: bool | None = None
    file_path: str | None = None
    formula_ocr: bool = False


@dataclass
class ParseWarning:
    message: str
    code: str
    page: int | None = None


@dataclass
class OutlineItem:
    level: int
    text: str
    page_number: int | None = None


@dataclass
class ExtractedImage:
    filename: str
    data: bytes
    mime_type: str


@dataclass
class ParseFailure:
    file_type: str
    error: str
    code: str
    success: bool = False


@dataclass
class ParseSuccess:
    file_type: str
    markdown: str
    blocks: list[IRBlock] = field(default_factory=list)
    page_count: int | None = None
    metadata: DocumentMetadata | None = None
    outline: list[OutlineItem] = field(default_factory=list)
    warnings: list[ParseWarning] = field(default_factory=list)
    images: list[ExtractedImage] = field(default_factory=list)
    success: bool = True


ParseResult = ParseSuccess | ParseFailure


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("paperloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def detect_format(data: bytes) -> str:
    """The format by the first bytes: a ZIP file is ``hwpx`` and an OLE2 file ``hwp`` until one looks into it."""
    from paperloom.sources import scan

    x = _session().createDataFrame([(bytearray(data),)], "content binary")
    return x.select(scan.coarse_format(F.col("content"))).first()[0]


def detect_zip_format(data: bytes) -> str:
    from paperloom.sources import scan

    return scan.zip_kind(data)


def detect_ole2_format(data: bytes) -> str:
    from paperloom.sources import scan

    return scan.ole_kind(data)


def _table(cells: list[Row]) -> IRTable:
    n, m = max(c.r for c in cells) + 1, max(c.c + c.col_span for c in cells)
    rows = [[IRCell("") for _ in range(m)] for _ in range(n)]
    for c in cells:
        rows[c.r][c.c] = IRCell(c.text, c.col_span, c.row_span)
    return IRTable(n, m, rows, n > 1)


def parse(data: bytes, options: ParseOptions | None = None) -> ParseResult:
    """Find out a document's format and convert it.  Runs the plan for collections over the one document."""
    from paperloom.plans import convert

    options = options or ParseOptions()
    tell = options.on_progress or (lambda done, total: None)
    docs = _session().createDataFrame([(0, bytearray(data or b""))], "doc_id long, content binary")
    tell(0, 1)
    with convert.Conversion(docs, options.pages) as c:
        r = c.results().first()
        if not r.success:
            tell(1, 1)
            return ParseFailure(r.file_type, r.error, r.code)
        grids: dict[tuple[int, int], list[Row]] = {}
        for x in c.grids.collect():
            grids.setdefault((x.section, x.ord), []).append(x)
        found = c.blocks.orderBy("section", "ord").collect()
        meta = convert.metadata(c.rows).first()
        images = convert.images(c.rows).where("filename IS NOT NULL").orderBy("section", "ord").collect()
        said = convert.warnings(c.rows).collect()
    tell(1, 1)

    def block(b: Row) -> IRBlock:
        table = _table(grids[b.section, b.ord]) if b.type == "table" else None
        style = InlineStyle(b.bold, b.italic, b.font_size, b.font_name) if b.font_size or b.bold or b.italic or b.font_name else None
        return IRBlock(b.type, b.text, table, b.level, b.page_number, style, b.list_type, b.href, b.footnote_text)

    return ParseSuccess(
        r.file_type,
        r.markdown,
        [block(b) for b in found],
        r.page_count,
        DocumentMetadata(meta.title, meta.author, None, meta.created_at, meta.modified_at, meta.page_count, meta.version, meta.description, list(meta.keywords) or None),
        [OutlineItem(b.level, b.text, b.page_number) for b in found if b.type == "heading"],
        [ParseWarning(w.message, w.code, w.page) for w in said],
        [ExtractedImage(i.filename, bytes(i.data), i.mime_type) for i in images],
    )


def parse_file(path: str, options: ParseOptions | None = None) -> ParseResult:
    return parse(Path(path).read_bytes(), options)
