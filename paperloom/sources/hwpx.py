"""Decoding of HWPX: sections of XML in a ZIP file, and what is left of them in a broken one."""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from paperloom.functions.equation import script_latex
from paperloom.functions.text import TRAVERSAL
from paperloom.sources.rows import Row, Unreadable, nested_mark, row
from paperloom.sources.scan import MAX_ENTRIES, MAX_UNZIPPED
from paperloom.sources.xmltree import Node, parse

MAX_DEPTH, MAX_ROWS, MAX_COLS = 200, 10_000, 200
PICTURES, NOTES = ("pic", "shape", "drawingObject"), ("footNote", "endNote", "fn", "en")
#: Parts of a paragraph that hold no text of its own.
SILENT = frozenset("fieldBegin fieldEnd parameters stringParam integerParam boolParam floatParam secPr colPr linesegarray lineseg shapeComment drawText tbl".split()) | set(PICTURES)
#: The media type and the extension of images by the extension of their part.
IMAGE_TYPES = {
    "jpg": ("image/jpeg", "jpg"), "jpeg": ("image/jpeg", "jpg"), "png": ("image/png", "png"), "gif": ("image/gif", "gif"), "bmp": ("image/bmp", "bmp"),
    "tif": ("image/tiff", "tif"), "tiff": ("image/tiff", "tif"), "wmf": ("image/wmf", "wmf"), "emf": ("image/emf", "emf"), "svg": ("image/svg+xml", "svg"),
}
#: Names of each metadata field in the order they are looked for.
META_TAGS = {"title": ("title",), "author": ("creator", "lastModifiedBy"), "description": ("description", "subject"), "created_at": ("created", "creation-date"), "modified_at": ("modified", "date"), "keywords": ("keyword", "keywords")}
META_PARTS = ("meta.xml", "meta-inf/meta.xml", "docprops/core.xml")
#: Fixed value: what a generated description of a picture begins with.
PICTURE_TEXT = re.compile(r"그림입니다\.?\s*원본\s*그림의\s*(이름|크기)")
_LEADER = "\x1f"
_LINK = re.compile(r"(?:https?:|mailto:|tel:|#)", re.IGNORECASE)


def unsafe(name: str) -> bool:
    return re.search(TRAVERSAL, name) is not None


def metadata(z: zipfile.ZipFile) -> Iterator[Row]:
    """Each field from the first part that has it; later parts are read while neither title nor author is known."""
    parts = {n.lower(): n for n in z.namelist()}
    found: dict[str, str] = {}
    for part in META_PARTS:
        if part not in parts or "title" in found or "author" in found:
            continue
        try:
            nodes = list(parse(z.read(parts[part])).walk())
        except Exception:
            continue
        for name, tags in META_TAGS.items():
            text = next((t for n in nodes if n.tag in tags and (t := n.text.strip())), None)
            if text:
                found.setdefault(name, text)
    for i, word in enumerate(w.strip() for w in re.split("[,;]", found.pop("keywords", ""))):
        if word:
            yield row("meta", ord=i, text=word, name="keyword")
    for name, text in found.items():
        yield row("meta", text=text, name=name)


def section_parts(z: zipfile.ZipFile) -> list[str]:
    names = z.namelist()
    manifest = next((n for n in names if n.lower().endswith("content.hpf")), None)
    if manifest:
        root = parse(z.read(manifest))
        items = {n.attrs.get("id", ""): n.attrs.get("href", "") for n in root.walk() if n.tag == "item"}
        is_section = lambda i: i.lower().startswith("s") or "section" in i.lower()
        order = [n.attrs.get("idref", "") for n in root.walk() if n.tag == "itemref"]
        found = [items[i] for i in order if i in items and is_section(i)] or sorted(h for i, h in items.items() if is_section(i))
        if found:
            return [h if "/" in h else f"Contents/{h}" for h in found]
    return sorted(n for n in names if re.search(r"[Ss]ection\d+\.xml$", n))


def paragraph_text(node: Node) -> tuple[str, str | None, list[str]]:
    """(text, link, notes) of a paragraph."""
    parts: list[str] = []
    links: list[str] = []
    notes: list[str] = []

    def said(text: str) -> None:
        if text.strip():  # white space between elements is layout of the file
            parts.append(text)

    def inside(n: Node, depth: int) -> None:
        for k in n.kids if depth < MAX_DEPTH else ():
            if k.tag == "t":
                parts.append(k.text)
                inside(k, depth + 1)
            elif k.tag in NOTES:
                if text := "".join(t.full_text() for t in k.walk() if t.tag == "t").strip() or k.full_text().strip():
                    notes.append(text)
            elif k.tag == "ctrl":  # of control objects only notes belong to the text
                for c in k.kids:
                    if c.tag in NOTES and (text := "".join(t.full_text() for t in c.walk() if t.tag == "t").strip()):
                        notes.append(text)
            elif k.tag == "equation":
                script = k.find("script")
                latex = script_latex(script.full_text()).strip() if script else ""
                parts.append(f" ${latex}$ " if latex else "")
            elif k.tag == "tab":
                parts.append(_LEADER if k.attrs.get("leader", "0") not in ("", "0") else "\t")
            elif k.tag == "br":
                parts.append("\n" if k.attrs.get("type", "line") == "line" else "")
            elif k.tag in ("fwSpace", "hwSpace"):
                parts.append(" ")
            elif k.tag not in SILENT:
                if k.tag == "hyperlink" and _LINK.match(url := (k.attrs.get("url") or k.attrs.get("href") or "").strip()):
                    links.append(url)
                said(k.text)
                inside(k, depth + 1)
            if n.tag == "t":
                parts.append(k.tail)
            else:
                said(k.tail)

    inside(node, 0)
    text = re.sub(r"[ \t]+", " ", "".join(parts).partition(_LEADER)[0]).strip()
    return ("" if PICTURE_TEXT.match(text) else text), links[-1] if links else None, notes


def _number(n: Node | None, key: str, default: int | None) -> int | None:
    value = n.attrs.get(key, "") if n else ""
    return int(value) if value.isdigit() else default


class _Section:
    """Rows of one section; ``tables`` counts the nested tables of the whole document."""

    def __init__(self, z: zipfile.ZipFile | None, number: int, first: int, tables: int, rule: str | None = None):
        self.z, self.names = z, sorted(z.namelist()) if z else []
        self.number, self.next, self.tables, self.rule = number, first, tables, rule
        self.rows: list[Row] = []

    def place(self) -> int:
        self.next += 1
        return self.next - 1

    def content(self, node: Node, depth: int = 0) -> None:
        for k in node.kids if depth < MAX_DEPTH else ():
            if k.tag == "p":
                self.paragraph(k)
                self.objects(k, None, depth + 1)
            elif k.tag == "tbl":
                self.table(k, depth + 1)
            elif k.tag in PICTURES:
                self.picture(k, True)
            else:
                self.content(k, depth + 1)

    def paragraph(self, p: Node) -> None:
        text, link, notes = paragraph_text(p)
        at = self.place()
        if not text:
            return
        runs = [n for n in p.kids if n.tag in ("run", "r")]
        here = f"{self.number}:{at}"
        if link:
            self.rows.append(row("rel", text=link, id=here))
        if notes:
            self.rows.append(row("note", text="; ".join(notes), id=here))
        self.rows.append(row("paragraph", self.number, at, text=text, char=next((c for n in runs if (c := n.attrs.get("charPrIDRef"))), None), link=here if link else None, note=here if notes else None, rule=self.rule))

    def objects(self, node: Node, cell: list[str] | None, depth: int) -> None:
        """Tables, pictures and text boxes in a paragraph, which stands in a table cell if ``cell`` is given."""
        for k in node.kids if depth < MAX_DEPTH else ():
            if k.tag == "tbl":
                found = self.table(k, depth + 1)
                if cell is not None and found:
                    cell.append(self.mark(found))
            elif k.tag in PICTURES:
                self.picture(k, False)
            elif k.tag == "drawText":
                self.box(k, depth + 1)
            else:
                self.objects(k, cell, depth + 1)

    def mark(self, cells: list[list[str]]) -> str:
        self.tables += 1
        hint = " | ".join(t for x in cells[0] if (t := x.strip().replace("\n", " ")))
        return nested_mark(self.tables, hint)

    def box(self, node: Node, depth: int) -> None:
        for k in node.kids if depth < MAX_DEPTH else ():
            if k.tag == "subList":
                self.box(k, depth + 1)
            elif k.tag in ("p", "para"):
                self.paragraph(k)

    def picture(self, node: Node, alone: bool) -> None:
        drawn = next((n for n in node.walk() if n.tag == "drawText"), None)
        if drawn:
            return self.box(drawn, 0)
        shown = [n.attrs.get("binaryItemIDRef") or n.attrs.get("href") for n in node.walk() if n.tag in ("imgRect", "img", "imgClip")]
        ref = next((x for x in [*shown, node.attrs.get("binaryItemIDRef")] if x), None)
        if ref and self.z is not None:
            part = self.image_part(ref)
            mime, ext = IMAGE_TYPES.get(part.rpartition(".")[2].lower(), IMAGE_TYPES["png"]) if part else (None, None)
            try:
                data = self.z.read(part) if part else None
            except Exception:
                data = None
            self.rows.append(row("image", self.number, self.place(), text=ref, data=data, mime=mime, ext=ext))
        elif ref:
            self.rows.append(row("image", self.number, self.place(), text=ref))
        elif alone:
            self.rows.append(row("warning", self.number, text=f"그림이 들어 있지 않은 {node.tag} 요소", code="SKIPPED_IMAGE"))
        return None

    def image_part(self, ref: str) -> str | None:
        """The part that a picture names, mostly without its extension; of several the one whose whole name it is."""
        places = [f"BinData/{ref}", f"Contents/BinData/{ref}", ref]
        longer = [] if "." in ref else [sorted((n for n in self.names if n.startswith(p) and "." in n[len(p) :]), key=lambda n: (not n.startswith(p + "."), n)) for p in places[:2]]
        return next((p for p in [*(x[0] for x in longer if x), *places] if p in self.names and not unsafe(p)), None)

    def table(self, t: Node, depth: int, loose: list[str] | None = None) -> list[list[str]]:
        """Puts the rows of a table, behind those of tables in it, and gives back the cells' texts.

        With ``loose``, the text of the cell around it, a small table goes there as text.
        """
        cells, texts = [], []
        for line in t.all("tr"):
            said = []
            for c, cell in enumerate(line.all("tc")):
                parts: list[str] = []
                self.cell(cell, parts, depth + 1)
                addr, span = cell.find("cellAddr"), cell.find("cellSpan")
                text = "\n".join(parts)
                said.append(text)
                cells.append((_number(addr, "rowAddr", len(texts)), _number(addr, "colAddr", c), text, dict(span=min(MAX_COLS, max(1, _number(span, "colSpan", 1))), rows=min(MAX_ROWS, max(1, _number(span, "rowSpan", 1))), placed=1 if addr else None)))
            if said:
                texts.append(said)
        if loose is not None and texts and (len(texts) < 3 or max(map(len, texts)) < 2):
            mark = self.mark(texts)
            lines = [" / ".join(x for v in said if (x := v.strip().replace("\n", " ").replace("|", "\\|"))) for said in texts]
            loose += [mark, *filter(None, lines), mark]
            return texts
        at = self.place()
        self.rows += [row("cell", self.number, at, r, c, text, i=i, lines=len(texts), **attrs) for i, (r, c, text, attrs) in enumerate(cells)]
        if loose is not None and texts:
            loose.append(self.mark(texts))
        return texts

    def cell(self, node: Node, parts: list[str], depth: int) -> None:
        for k in node.kids if depth < MAX_DEPTH else ():
            if k.tag == "p":
                if text := paragraph_text(k)[0]:
                    parts.append(text)
                self.objects(k, parts, depth + 1)
            elif k.tag == "tbl":
                self.table(k, depth + 1, parts)
            elif k.tag in PICTURES:
                self.picture(k, True)
            else:
                self.cell(k, parts, depth + 1)


def sections(z: zipfile.ZipFile) -> Iterator[Row]:
    names = set(z.namelist())
    if "META-INF/manifest.xml" in names and b"encryption-data" in z.read("META-INF/manifest.xml"):
        raise Unreadable("암호화된 HWPX라 읽지 못합니다")
    yield from metadata(z)
    header = next((n for n in z.namelist() if n.endswith("header.xml")), None)
    if header:
        for n in parse(z.read(header)).walk():
            ident = n.attrs.get("id") or n.attrs.get("IDRef") if n.tag in ("charPr", "char_pr") else None
            if ident:
                height = n.attrs.get("height", "")
                face = next((f for k in n.walk() if k.tag in ("fontface", "fontRef") and (f := k.attrs.get("face") or k.attrs.get("FontFace"))), None)
                on = {k: 1 if n.attrs.get(k) in ("true", "1") else None for k in ("bold", "italic")}
                yield row("char", id=ident, size=int(height) / 100 if height.isdigit() and int(height) else None, face=face, **on)
    parts = section_parts(z)
    if not parts:
        raise Unreadable("읽을 섹션을 찾을 수 없는 HWPX입니다")
    yield row("meta", text=str(len(parts)), name="page_count")
    count = tables = 0
    for s, part in enumerate(parts):
        if part not in names:
            continue
        try:
            root = parse(z.read(part))
        except Exception as e:
            yield row("warning", s, text=f"섹션 {s + 1}: {e}", code="MALFORMED_XML")
            continue
        section = _Section(z, s, count, tables)
        section.content(root)
        yield from section.rows
        count, tables = section.next, section.tables


def _local_files(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and contents of sections by the heads in front of them, without the directory at the end."""
    resume = unpacked = 0
    for n, found in enumerate(re.finditer(rb"PK\x03\x04", content)):
        at = found.start()
        if n >= MAX_ENTRIES or at + 30 > len(content):
            return
        if at < resume:
            continue
        flags, method, size, width, extra = struct.unpack_from("<6xHH8xI4xHH", content, at)
        name = content[at + 30 : at + 30 + width].decode("utf-8", "replace")
        begin = at + 30 + width + extra
        streamed = size == 0 and method == 8 and flags & 8  # its size stands behind it
        if width > 1024 or begin + size > len(content) or unsafe(name):
            continue
        resume = begin + size
        if "section" not in name.lower() or not name.endswith(".xml") or method not in (0, 8):
            continue
        try:
            raw = content[begin:] if streamed else content[begin : begin + size]
            raw = zlib.decompressobj(-15).decompress(raw, MAX_UNZIPPED + 1) if method else raw
        except zlib.error:
            continue
        unpacked += len(raw)
        if unpacked > MAX_UNZIPPED:
            raise Unreadable("HWPX의 압축 해제 한도를 넘었습니다")
        yield name, raw


def recovered(content: bytes) -> Iterator[Row]:
    """The sections of a file whose ZIP directory can't be read, without styles and images."""
    yield row("warning", text="ZIP 목록이 깨져 남은 섹션만 읽었습니다", code="BROKEN_ZIP_RECOVERY")
    number = count = tables = 0
    any_content = False
    for name, raw in _local_files(content):
        try:
            root = parse(raw)
        except Exception as e:
            yield row("warning", number, text=f"{name}: {e}", code="MALFORMED_XML")
            continue
        section = _Section(None, number, count, tables, "none")
        section.content(root)
        yield from section.rows
        any_content = any_content or any(r["kind"] != "warning" for r in section.rows)
        number, count, tables = number + 1, section.next, section.tables
    if not any_content:
        raise Unreadable("깨진 HWPX라 복구할 수 없습니다")
