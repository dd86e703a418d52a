"""Byte-level decoding: one pass over each document's bytes into tagged rows.

Every row has (doc_id, kind, section, ord, r, c, text, attrs, data).  All look-ups, placement and
rendering are left to DataFrame operations on these rows.  A document that can't be read
becomes an ``error`` row, never a failed task.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from paperloom.functions.equation import office_math_latex
from paperloom.functions.text import a1
from paperloom.sources import biff, hwp3, hwp5, scan
from paperloom.sources import hwpx as hwpx_parts
from paperloom.sources.rows import Row, Unreadable, nested_mark, row, truncated
from paperloom.sources.scan import MAX_ENTRIES, MAX_UNZIPPED, zip_directory
from paperloom.sources.xmltree import Node, parse

ROWS = "doc_id long, kind string, section int, ord long, r int, c int, text string, attrs map<string,string>, data binary"
MAX_SHEETS, MAX_ROWS, MAX_COLS = 100, 10_000, 200


def _open_zip(content: bytes) -> zipfile.ZipFile:
    size, entries = zip_directory(content)
    if entries > MAX_ENTRIES:
        raise Unreadable(f"ZIP 엔트리 수 초과, {MAX_ENTRIES}개까지: {entries}")
    if size > MAX_UNZIPPED:
        raise Unreadable(f"ZIP 비압축 크기 초과, {MAX_UNZIPPED >> 20} MiB까지: {size} B")
    return zipfile.ZipFile(io.BytesIO(content))


def _relations(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    if name not in z.namelist():
        return {}
    return {n.attrs.get("Id", ""): n.attrs.get("Target", "") for n in parse(z.read(name)).walk() if n.tag == "Relationship"}


def _core(z: zipfile.ZipFile) -> Iterator[Row]:
    if "docProps/core.xml" in z.namelist():
        names = {"title": "title", "creator": "author", "description": "description", "created": "created_at", "modified": "modified_at"}
        for n in parse(z.read("docProps/core.xml")).walk():
            if n.tag in names and n.full_text().strip():
                yield row("meta", text=n.full_text().strip(), name=names[n.tag])


def xlsx(content: bytes) -> Iterator[Row]:
    with _open_zip(content) as z:
        names = set(z.namelist())
        if "xl/sharedStrings.xml" in names:
            for i, si in enumerate(n for n in parse(z.read("xl/sharedStrings.xml")).walk() if n.tag == "si"):
                yield row("string", ord=i, text="".join(t.full_text() for t in si.walk() if t.tag == "t"))
        sheets = [n for n in parse(z.read("xl/workbook.xml")).walk() if n.tag == "sheet"]
        if not sheets:
            raise Unreadable("시트가 하나도 들어 있지 않습니다")
        rels = _relations(z, "xl/_rels/workbook.xml.rels")
        yield row("meta", text=str(min(len(sheets), MAX_SHEETS)), name="page_count")
        yield from _core(z)
        for i, sheet in enumerate(sheets[:MAX_SHEETS]):
            name = sheet.attrs.get("name", f"Sheet{i + 1}")
            target = rels.get(sheet.attrs.get("id", ""), "") or f"worksheets/sheet{i + 1}.xml"
            part = target[1:] if target.startswith("/") else target if target.startswith("xl/") else f"xl/{target}"
            yield row("sheet", i, text=name)
            if part not in names:
                yield row("warning", i, text=f'시트 "{name}"의 {part} 부분이 빠져 있습니다', code="PARTIAL_PARSE")
                continue
            try:
                yield from list(_worksheet(parse(z.read(part)), i))
            except Exception as e:
                yield row("warning", i, text=f'시트 "{name}"을 끝까지 읽지 못했습니다: {e}', code="PARTIAL_PARSE")


def _worksheet(root: Node, section: int) -> Iterator[Row]:
    beyond = 0
    for line in (n for n in root.walk() if n.tag == "row"):
        try:
            r = int(line.attrs.get("r", "")) - 1
        except ValueError:
            continue
        for cell in line.all("c") if r >= 0 else ():
            at = a1(cell.attrs.get("r", ""))
            if r >= MAX_ROWS or (at and at[1] >= MAX_COLS):
                beyond += 1
            if r >= MAX_ROWS or at is None or at[1] >= MAX_COLS:
                continue
            v, f, inline = cell.find("v"), cell.find("f"), cell.find("is")
            kind = cell.attrs.get("t", "n")
            text = "".join(t.full_text() for t in inline.walk() if t.tag == "t") if kind == "inlineStr" and inline else v.full_text() if v else None
            yield row("cell", section, r=r, c=at[1], text=text, type=kind, formula=f.full_text() if f else None)
    if beyond:
        yield truncated(section, beyond)
    for m in (n for n in root.walk() if n.tag == "mergeCell"):
        ends = [a1(x) for x in m.attrs.get("ref", "").split(":")]
        if len(ends) == 2 and all(ends):
            (r1, c1), (r2, c2) = ends
            yield row("merge", section, r1=r1, c1=c1, r2=r2, c2=c2)


def docx(content: bytes) -> Iterator[Row]:
    with _open_zip(content) as z:
        names = set(z.namelist())
        rels = _relations(z, "word/_rels/document.xml.rels")
        for rid, target in rels.items():
            yield row("rel", text=target, id=rid)
        if "word/styles.xml" in names:
            for s in (n for n in parse(z.read("word/styles.xml")).walk() if n.tag == "style"):
                level = next((n.attrs.get("val") for n in s.walk() if n.tag == "outlineLvl"), None)
                name = next((n.attrs.get("val", "") for n in s.kids if n.tag == "name"), "")
                if level is None and (named := re.fullmatch(r"heading\s*(\d+)", name, re.IGNORECASE)):
                    level = str(int(named[1]) - 1)
                yield row("style", id=s.attrs.get("styleId"), outline=level)
        if "word/numbering.xml" in names:
            root = parse(z.read("word/numbering.xml"))
            abstract = {a.attrs.get("abstractNumId"): a for a in root.all("abstractNum")}
            for num in root.all("num"):
                ref = num.find("abstractNumId")
                for lvl in abstract[ref.attrs.get("val")].all("lvl") if ref and ref.attrs.get("val") in abstract else ():
                    fmt = lvl.find("numFmt")
                    yield row("numbering", num=num.attrs.get("numId"), ilvl=lvl.attrs.get("ilvl", "0"), fmt=fmt.attrs.get("val") if fmt else None)
        if "word/footnotes.xml" in names:
            for n in parse(z.read("word/footnotes.xml")).all("footnote"):
                if n.attrs.get("id") not in ("0", "-1"):
                    yield row("note", text="".join(t.full_text() for t in n.walk() if t.tag == "t"), id=n.attrs.get("id"))
        yield from _core(z)
        root = parse(z.read("word/document.xml"))
        body = root.find("body")
        for i, e in enumerate(_docx_body(body) if body else ()):
            if e.tag == "p":
                yield _docx_paragraph(e, i)
            elif e.tag == "tbl":
                for r, tr in enumerate(e.all("tr")):
                    for c, tc in enumerate(tr.all("tc")):
                        pr = tc.find("tcPr")
                        span, merge = (pr.find("gridSpan"), pr.find("vMerge")) if pr else (None, None)
                        text = "\n".join(map(_docx_text, tc.all("p")))
                        width = int(span.attrs.get("val", "1")) if span and span.attrs.get("val", "1").isdigit() else 1
                        yield row("cell", ord=i, r=r, c=c, text=text, span=max(1, width), merge=(merge.attrs.get("val") or "continue") if merge else None)
        shown = (n.attrs.get("embed") for d in root.walk() if d.tag == "drawing" for n in d.walk() if n.tag == "blip")
        for i, target in enumerate(rels[x] for x in shown if rels.get(x)):
            part = target[1:] if target.startswith("/") else target if target.startswith("word/") else f"word/{target}"
            if part in names:
                ext = part.rpartition(".")[2].lower() if "." in part else "png"
                yield row("image", ord=i, text=target, data=z.read(part), mime=DOCX_IMAGES.get(ext, "image/png"), ext=ext, apart=1)


#: Media types of images by their extension.
DOCX_IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "wmf": "image/wmf", "emf": "image/emf"}


def _docx_body(node: Node) -> Iterator[Node]:
    """Paragraphs and tables, also those in content controls."""
    for k in node.kids:
        if k.tag in ("p", "tbl"):
            yield k
        elif k.tag in ("sdt", "sdtContent", "customXml", "ins"):
            yield from _docx_body(k)


def _docx_text(n: Node) -> str:
    """The text of runs, with each formula where it stands."""
    if n.tag in ("oMath", "oMathPara"):
        latex, mark = office_math_latex(n), "$$" if n.tag == "oMathPara" else "$"
        return f" {mark}{latex}{mark} " if latex else ""
    if n.tag == "r":
        marks = {"tab": "\t", "br": "\n", "cr": "\n"}
        return "".join(marks.get(k.tag) or _docx_text(k) for k in n.kids)
    return n.full_text() if n.tag == "t" else "".join(map(_docx_text, n.kids))


def _docx_paragraph(p: Node, i: int) -> Row:
    pr = p.find("pPr")
    get = lambda *path: (n.attrs.get("val") if (n := pr.find(*path)) else None) if pr else None
    links = [n.attrs.get("id") for n in p.walk() if n.tag == "hyperlink"]
    notes = [n.attrs.get("id") for n in p.walk() if n.tag == "footnoteReference"]
    text = re.sub(r"[ \t]{2,}", " ", _docx_text(p)).strip()
    return row("paragraph", ord=i, text=text, style=get("pStyle"), outline=get("outlineLvl"), num=get("numPr", "numId"), ilvl=get("numPr", "ilvl") or "0", link=links[-1] if links else None, note=notes[-1] if notes else None)


MAX_HWPML = 50 << 20


def hwpml(content: bytes) -> Iterator[Row]:
    if len(content) > MAX_HWPML:
        raise Unreadable(f"HWPML 크기 초과: {len(content)} B")
    root = parse(content.decode("utf-8", "replace").lstrip("﻿").replace("&nbsp;", "&#160;"))
    summary = next((n for n in root.walk() if n.tag == "DOCSUMMARY"), None)
    for n in summary.kids if summary else ():
        if n.tag in ("TITLE", "AUTHOR", "DATE") and n.full_text().strip():
            yield row("meta", text=n.full_text().strip(), name={"TITLE": "title", "AUTHOR": "author", "DATE": "created_at"}[n.tag])
    for n in root.walk():
        if n.tag == "PARASHAPE" and n.attrs.get("HeadingType") == "Outline":
            level = n.attrs.get("Level", "0")
            yield row("style", id=n.attrs.get("Id"), outline=level if re.fullmatch(r"-?\d+", level) else "0")
    count, tables = 0, itertools.count(1)
    for s, section in enumerate(n for n in root.walk() if n.tag == "SECTION"):
        for p in _hwpml_content(section, 0):
            if p.tag == "P":
                text = "".join(n.full_text() for n in p.walk() if n.tag == "CHAR")
                yield row("paragraph", s, count, text=text, style=p.attrs.get("ParaShape"))
            else:
                yield from _hwpml_table(p, s, count, tables)
            count += 1


def _hwpml_content(node: Node, depth: int) -> Iterator[Node]:
    """Paragraphs, and tables whether they stand beside or in one; headers and footers are left out."""
    for k in node.kids if depth < 200 else ():
        if k.tag in ("HEADER", "FOOTER"):
            continue
        if k.tag == "P":
            inner = [t for t in _hwpml_content(k, depth + 1) if t.tag == "TABLE"]
            own = Node.__new__(Node)
            own.tag, own.attrs, own.text, own.tail, own.kids = "P", k.attrs, "", "", _without(k, "TABLE").kids
            yield own
            yield from inner
        elif k.tag == "TABLE":
            yield k
        else:
            yield from _hwpml_content(k, depth + 1)


def _without(node: Node, tag: str) -> Node:
    out = Node.__new__(Node)
    out.tag, out.attrs, out.text, out.tail = node.tag, node.attrs, node.text, node.tail
    out.kids = [_without(k, tag) for k in node.kids if k.tag != tag]
    return out


def _hwpml_rows(t: Node) -> Iterator[Node]:
    """The rows of a table, without those of tables in it."""
    for k in t.kids:
        if k.tag == "ROW":
            yield k
        elif k.tag != "TABLE":
            yield from _hwpml_rows(k)


def _hwpml_lines(cell: Node, tables: Iterator[int]) -> Iterator[str]:
    """The paragraphs of a cell; a table in one leaves a mark."""
    for p in _hwpml_content(cell, 0):
        if p.tag == "P":
            yield "".join(x.full_text() for x in p.walk() if x.tag == "CHAR")
        else:
            yield nested_mark(next(tables))


def _hwpml_table(t: Node, section: int, at: int, tables: Iterator[int]) -> Iterator[Row]:
    whole = lambda n, k: int(v) if (v := n.attrs.get(k, "")).isdigit() else 0
    if whole(t, "RowCount") > 5000 or whole(t, "ColCount") > 500:
        yield row("warning", section, text="한도보다 큰 표를 생략했습니다", code="TRUNCATED_TABLE")
        return
    lines = list(_hwpml_rows(t))
    nth = itertools.count()
    for r, line in enumerate(lines):
        for c, cell in enumerate(line.all("CELL")):
            text = "\n".join(_hwpml_lines(cell, tables))
            yield row("cell", section, at, whole(cell, "RowAddr") if "RowAddr" in cell.attrs else r, whole(cell, "ColAddr") if "ColAddr" in cell.attrs else c, text, span=max(1, whole(cell, "ColSpan")), rows=max(1, whole(cell, "RowSpan")), placed=1, i=next(nth), lines=len(lines))


def hwpx(content: bytes) -> Iterator[Row]:
    try:
        z = _open_zip(content)
    except Unreadable:
        raise
    except Exception:  # zipfile fails in many ways on a damaged directory
        yield from hwpx_parts.recovered(content)
        return
    with z:
        yield from hwpx_parts.sections(z)


DECODERS = {"xlsx": xlsx, "docx": docx, "hwpml": hwpml, "hwpx": hwpx, "xls": biff.xls, "hwp": hwp5.hwp, "hwp3": hwp3.hwp3}
_FIELDS = ("kind", "section", "ord", "r", "c", "text", "attrs", "data")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("section", pa.int32()), ("ord", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("data", pa.binary())])


#: Rows and bytes of text and data that go back together; a document's rows may be more.
OUT_ROWS, OUT_BYTES = 2000, 1 << 20
#: Python holds two batches of files at a time, so these are small whatever the input's size.
IN_BYTES = "2m"


def _rows(file_type: str, raw: bytes) -> list[Row]:
    try:
        if file_type == scan.OVERSIZED:
            rows = [row("error", text=f"파일이 {scan.MAX_FILE >> 20}MB보다 큽니다", code="FILE_TOO_LARGE")]
        elif not raw:
            rows = [row("error", text="빈 입력입니다", code="EMPTY_INPUT")]
        elif file_type not in DECODERS:
            rows = [row("error", text=f"읽을 줄 모르는 포맷입니다: {file_type}", code="UNSUPPORTED_FORMAT")]
        else:
            rows = list(DECODERS[file_type](raw))
    except Exception as e:
        rows = [row("error", text=str(e))]
    rows.append(row("document", text=file_type))
    return rows


def _packed(ids: list[int], rows: list[Row]) -> pa.RecordBatch:
    columns = {f: pa.array([list(x[f].items()) if f == "attrs" else x[f] for x in rows], _SCHEMA.field(f).type) for f in _FIELDS}
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64())} | columns, schema=_SCHEMA)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of files (doc_id, file_type or coarse, content), those of small ones together."""
    for batch in batches:
        coarse = "coarse" in batch.schema.names
        ids: list[int] = []
        rows: list[Row] = []
        size = 0
        for doc_id, file_type, content in zip(batch["doc_id"].to_pylist(), batch["coarse" if coarse else "file_type"].to_pylist(), batch["content"], strict=True):
            raw = content.as_py() or b""
            found = _rows(scan.refined(file_type, raw) if coarse else file_type, raw)
            ids += [doc_id] * len(found)
            rows += found
            size += sum(len(x["text"] or "") + len(x["data"] or b"") for x in found)
            if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                yield _packed(ids, rows)
                ids, rows, size = [], [], 0
        if rows:
            yield _packed(ids, rows)


def _kept(files: DataFrame) -> DataFrame:
    """The tagged rows of files.

    Many branches of a plan read them, so they are kept while it runs; what a lost executor held is decoded again.
    """
    conf, key = files.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:  # what a user has set stays
        conf.set(key, IN_BYTES)
    return files.mapInArrow(_decode, ROWS).persist(StorageLevel.MEMORY_AND_DISK)


def decode(detected: DataFrame) -> DataFrame:
    """The tagged rows of documents (doc_id, file_type, content)."""
    return _kept(detected.select("doc_id", "file_type", "content"))


def read(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, content, maybe length), whose formats are found in the same pass."""
    return _kept(scan.marked(docs))
