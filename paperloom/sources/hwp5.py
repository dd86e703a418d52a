"""HWP 5.x documents: the record tree of each section as tagged rows."""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

from paperloom.functions.equation import script_latex
from paperloom.sources import aes
from paperloom.sources.cfb import BadCompoundFile, streams
from paperloom.sources.rows import Row, Unreadable, nested_mark, row

MAX_SECTIONS, MAX_INFLATED, MAX_RECORDS = 100, 100 << 20, 500_000
MAX_ROWS, MAX_COLS = 10_000, 200
BIN_DATA, CHAR_SHAPES, PARA_SHAPES, STYLES, DISTRIBUTED = 0x12, 0x15, 0x19, 0x1A, 0x1C
PARAGRAPH, TEXT, CHARS, CONTROL, LIST, TABLE, PICTURE, EQUATION = 0x42, 0x43, 0x44, 0x47, 0x48, 0x4D, 0x55, 0x58
COMPRESSED, ENCRYPTED, DISTRIBUTION, DRM = 1, 2, 4, 16
PICTURE_ITEM = 71  # where a picture record names its binary item
LINKS = ("%hlk", "%tok", "klnk")
NOTES, BOX, OBJECT = ("fn  ", "en  "), "gso ", "ole "
#: Room behind a table for the paragraphs that a layout table becomes.
STEP = 1 << 20


class Record:
    __slots__ = ("data", "kids", "level", "tag")

    def __init__(self, tag: int, level: int, data: bytes):
        self.tag, self.level, self.data, self.kids = tag, level, data, []

    @property
    def control(self) -> str:
        """The four letters of a control in reading order; some writers store them so, most the other way round."""
        name = self.data[:4].decode("latin-1") if self.tag == CONTROL else ""
        return name if name in ("tbl ", "eqed", BOX, OBJECT, *LINKS, *NOTES) else name[::-1]

    def walk(self) -> Iterator[Record]:
        yield self
        for k in self.kids:
            yield from k.walk()


def read_records(data: bytes) -> Iterator[Record]:
    at = 0
    for _ in range(MAX_RECORDS):
        if at + 4 > len(data):
            return
        head = struct.unpack_from("<I", data, at)[0]
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size, at = struct.unpack_from("<I", data, at)[0], at + 4
        if at + size > len(data):
            return
        yield Record(head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size])
        at += size


def tree(records: Iterator[Record]) -> list[Record]:
    """The records of the lowest level, each with the deeper ones that follow it below it."""
    top: list[Record] = []
    path: list[Record] = []
    for x in records:
        while path and path[-1].level >= x.level:
            path.pop()
        (path[-1].kids if path else top).append(x)
        path.append(x)
    return top


def inflate(data: bytes, limit: int = MAX_INFLATED) -> bytes:
    error: Exception | None = None
    for window in (15, -15) if data[:1] == b"\x78" else (-15,):
        z = zlib.decompressobj(window)
        try:
            out = z.decompress(data, limit + 1)
        except zlib.error as e:
            error = e
            continue
        if len(out) > limit:
            raise Unreadable("압축 해제 한도를 넘는 문서입니다")
        if z.eof:
            return out
        error = ValueError("incomplete stream")
    raise error or ValueError("no data")


def open_distributed(raw: bytes, compressed: bool) -> bytes:
    """A section of a distribution document: its first record hides the key of the rest."""
    head = next(read_records(raw), None)
    if head is None or head.tag != DISTRIBUTED or len(head.data) < 256:
        raise ValueError("배포용 문서의 첫 레코드가 올바르지 않습니다")
    body = raw[raw.index(head.data) + len(head.data) :]
    seed, mask = struct.unpack_from("<I", head.data)[0], []

    def rand() -> int:  # as the C run-time library's
        nonlocal seed
        seed = (seed * 214013 + 2531011) & 0xFFFFFFFF
        return seed >> 16 & 0x7FFF

    while len(mask) < 256:
        byte = rand() & 0xFF
        mask += [byte] * ((rand() & 0xF) + 1)
    plain = head.data[:4] + bytes(a ^ b for a, b in zip(head.data[4:256], mask[4:256], strict=True))
    key_at = 4 + (plain[0] & 0xF)
    if len(body) < 16:
        raise ValueError("배포용 문서의 본문이 비어 있습니다")
    opened = aes.decrypt(body, plain[key_at : key_at + 16])
    try:
        return inflate(opened) if compressed else opened
    except Unreadable:
        raise
    except Exception:  # noqa: BLE001  some writers encrypt what they have not packed
        return opened


#: A control of eight units begins with a code below 24 other than those of a line's and a paragraph's end.
_WIDE = re.compile("[\x01-\x09\x0b\x0c\x0e-\x17](.{7})", re.DOTALL)
_CONTROL = re.compile("[\x00-\x1f]")
_NARROW = str.maketrans({0: "\n", 10: "\n", 24: " ", 25: " ", 30: "-", 31: " "} | {k: None for k in [13, *range(1, 9), 11, 12, *range(14, 24), *range(26, 30)]})


def paragraph_text(data: bytes, equations: list[str]) -> str:
    """The text of a record; each equation control takes the next of ``equations``."""
    units = "".join(map(chr, struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])))

    def control(m: re.Match) -> str:
        name = "".join(chr(ord(u) >> s & 0xFF) for u in m[1][:2] for s in (0, 8))
        if m[0][0] == "\t":
            return "\t"
        return equations.pop(0) if name in ("deqe", "eqed") and equations else ""

    text = _WIDE.sub(control, units).replace("\r", "")
    if _CONTROL.search(text):
        text = text.translate(_NARROW)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _equation(control: Record) -> str | None:
    found = next((x for x in control.walk() if x.tag == EQUATION), None)
    if found is None or len(found.data) < 6:
        return None
    n = struct.unpack_from("<H", found.data, 4)[0]
    script = found.data[6 : 6 + 2 * n]
    if not n or len(script) < 2 * n:
        return None
    latex = script_latex(script.decode("utf-16-le", "replace").replace("\0", "").strip())
    return "$" + latex.replace("$", "\\$") + "$" if latex else None


class _Section:
    def __init__(self, number: int, nested: list[int], items: dict[int, tuple[str, bytes]]):
        self.number, self.nested, self.items, self.count = number, nested, items, 0

    def place(self) -> int:
        self.count += 1
        return (self.count - 1) * STEP

    def rows(self, top: list[Record]) -> Iterator[Row]:
        for x in top:
            if x.tag == PARAGRAPH:
                yield from self.paragraph(x)
            elif x.control == "tbl ":
                yield from self.table(x)

    def _own(self, x: Record) -> Iterator[Record]:
        """The records of a paragraph without what tables, notes and boxes hold."""
        for k in x.kids:
            yield k
            if k.control not in ("tbl ", BOX, *NOTES):
                yield from self._own(k)

    def _lines(self, control: Record) -> list[str]:
        """The paragraphs of a note or box, in lines."""
        lines: list[str] = []
        for p in (x for x in control.walk() if x.tag == PARAGRAPH):
            inside = list(self._own(p))
            equations = [e for x in inside if x.control == "eqed" and (e := _equation(x))]
            lines += [t for t in ["".join(paragraph_text(x.data, equations) for x in inside if x.tag == TEXT).strip()] if t]
        return lines

    def paragraph(self, p: Record) -> Iterator[Row]:
        """A paragraph with its notes, then the boxes, pictures and tables that it holds."""
        inside = list(self._own(p))
        equations = [e for x in inside if x.control == "eqed" and (e := _equation(x))]
        text = "".join(paragraph_text(x.data, equations) for x in inside if x.tag == TEXT).strip()
        if text:
            at = self.place()
            here = f"{self.number}:{at}"
            links = [u for x in inside if x.control in LINKS and (u := _address(x.data))]
            notes = [" ".join(lines) for x in inside if x.control in NOTES and (lines := self._lines(x))]
            style = struct.unpack_from("<H", p.data, 8)[0] if len(p.data) >= 10 else None
            yield row("paragraph", self.number, at, text=text, style=style, link=here if links else None, note=here if notes else None)
            if links:
                yield row("rel", text=links[0], id=here)
            if notes:
                yield row("note", text="; ".join(notes), id=here)
            shapes = [struct.unpack_from("<I", x.data, k)[0] for x in inside if x.tag == CHARS for k in range(4, len(x.data) // 8 * 8, 8)]
            yield from (row("shape", self.number, at, r=k, text=str(s)) for k, s in enumerate(shapes))
        for x in inside:
            if x.control == BOX:
                yield from self.box(x)
            elif x.tag == PICTURE and len(x.data) >= PICTURE_ITEM + 2:
                yield self.picture(struct.unpack_from("<H", x.data, PICTURE_ITEM)[0])
            elif x.control == "tbl ":
                yield from self.table(x)
            elif x.control == OBJECT:
                yield row("warning", self.number, text=f"개체를 건너뜀: {OBJECT.strip()}", code="SKIPPED_IMAGE")

    def box(self, control: Record) -> Iterator[Row]:
        """A drawing object: its picture, or the text in it, and tables there."""
        pictures = [x for x in control.walk() if x.tag == PICTURE and len(x.data) >= PICTURE_ITEM + 2]
        for x in pictures:
            yield self.picture(struct.unpack_from("<H", x.data, PICTURE_ITEM)[0])
        if lines := self._lines(control):
            yield row("paragraph", self.number, self.place(), text="\n".join(lines))
        for x in control.walk():
            if x.control == "tbl ":
                yield from self.table(x)

    def picture(self, item: int) -> Row:
        name, data = self.items.get(item, (f"BinData {item}", b""))
        return row("image", self.number, self.place(), text=name, data=data)

    def table(self, control: Record) -> Iterator[Row]:
        shape = next((x for x in control.kids if x.tag == TABLE and len(x.data) >= 8), None)
        rows, cols = struct.unpack_from("<HH", shape.data, 4) if shape else (0, 0)
        rows, cols = min(rows, MAX_ROWS), min(cols, MAX_COLS)
        cells: list[tuple[bytes, list[Record]]] = []
        for x in control.kids:
            if x.tag == LIST:
                cells.append((x.data, list(x.kids)))
            elif cells:
                cells[-1][1].append(x)
        texts = [self.cell(content) for _, content in cells]
        if not rows or not cols or not cells:
            return
        addressed = any(len(head) >= 16 for head, _ in cells)
        put: dict[tuple[int, int], tuple[str, int, int]] = {}
        for k, ((head, _), text) in enumerate(zip(cells, texts, strict=True)):
            c, r, wide, high = struct.unpack_from("<4H", head, 8) if len(head) >= 16 else (0, 0, 1, 1) if addressed else (k % cols, k // cols, 1, 1)
            if r < rows and c < cols:
                put[r, c] = text, min(max(wide, 1), MAX_COLS), min(max(high, 1), MAX_ROWS)
        covered = {(i, j) for (r, c), (_, w, h) in put.items() for i in range(r, min(r + h, rows)) for j in range(c, min(c + w, cols)) if (i, j) != (r, c)}
        at = self.place()
        for r in range(rows):
            for c in range(cols):
                if (r, c) not in covered:
                    text, wide, high = put.get((r, c), ("", 1, 1))
                    yield row("cell", self.number, at, r, c, text, span=wide, rows=high, placed=1, flow=1, whole=1 if addressed else None)

    def cell(self, content: list[Record]) -> str:
        """The paragraphs of a cell by line; a table in it leaves a mark and its text."""
        lines: list[str] = []
        pending: list[bytes] = []
        equations: list[str] = []

        def flush() -> None:
            text = "".join(paragraph_text(d, equations) for d in pending).strip()
            lines.extend([text] if text else [])
            pending.clear()
            equations.clear()

        for x in (y for k in content for y in k.walk()):
            if x.tag == PARAGRAPH:
                flush()
            elif x.tag == TEXT:
                pending.append(x.data)
            elif x.control == "eqed":
                equations.extend([e] if (e := _equation(x)) else [])
            elif x.control == "tbl ":
                flush()
                self.nested[0] += 1
                lines.append(nested_mark(self.nested[0]))
        flush()
        return "\n".join(lines)


def _address(data: bytes) -> str | None:
    m = re.search(r"https?://[^\0;]+", data[len(data) % 2 :].decode("utf-16-le", "ignore")) or re.search(r"https?://[^\0;]+", data[1:].decode("utf-16-le", "ignore"))
    return m[0].replace("\\", "") if m and len(m[0]) < 2000 else None


def _string(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<H", data, at)[0]
    return data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"), at + 2 + 2 * n


def _shapes(info: list[Record]) -> Iterator[Row]:
    """The look-up tables of a document: paragraph shapes, character shapes and styles."""
    numbers = {CHAR_SHAPES: 0, PARA_SHAPES: 0, STYLES: 0}
    for x in info:
        if x.tag == PARA_SHAPES and len(x.data) >= 4:
            level = struct.unpack_from("<I", x.data)[0] >> 25 & 7
            yield row("style", id=numbers[PARA_SHAPES], outline=level if 1 <= level <= 6 else None)
        elif x.tag == CHAR_SHAPES and len(x.data) >= 18:
            size = struct.unpack_from("<I", x.data, 42)[0] if len(x.data) >= 50 else 0
            marks = struct.unpack_from("<I", x.data, 46)[0] if len(x.data) >= 50 else 0
            yield row("char", id=numbers[CHAR_SHAPES], size=size / 10 if size else None, italic=1 if marks & 1 else None, bold=1 if marks & 2 else None)
        elif x.tag == STYLES and len(x.data) >= 8:
            try:
                local, at = _string(x.data, 0)
                name, at = _string(x.data, at) if at + 2 <= len(x.data) else ("", at)
                char = struct.unpack_from("<H", x.data, at + 7)[0] if at + 9 <= len(x.data) else 0
            except struct.error:
                continue
            yield row("named_style", ord=numbers[STYLES], text=(name or local).lower(), char=char)
        else:
            continue
        numbers[x.tag] += 1


def _items(info: list[Record], files: dict[str, bytes], compressed: bool) -> dict[int, tuple[str, bytes]]:
    """Name and content of each binary item, numbered from 1 as pictures name them."""
    stored = {}
    for path, data in files.items():
        m = re.fullmatch(r"(?i)BinData/(BIN([0-9A-F]{4})(\.\w*)?)", path)
        if m:
            stored[int(m[2], 16)] = m[1], data
    out = {}
    for k, x in enumerate((x for x in info if x.tag == BIN_DATA and len(x.data) >= 4), 1):
        kind, ident = struct.unpack_from("<HH", x.data)
        if kind & 0xF and ident in stored:
            name, data = stored[ident]
            if compressed if kind >> 4 & 3 == 0 else kind >> 4 & 3 == 1:
                try:
                    data = inflate(data)
                except Exception:  # noqa: BLE001, S110  kept as it is stored
                    pass
            out[k] = name, data
    return out


#: Property numbers of the summary.
_SUMMARY = {2: "title", 4: "author", 6: "description"}


def _summary(files: dict[str, bytes]) -> Iterator[Row]:
    raw = files.get("\x05HwpSummaryInformation") or files.get("\x05SummaryInformation") or b""
    if len(raw) < 48:
        return
    base = struct.unpack_from("<I", raw, 44)[0]
    count = struct.unpack_from("<I", raw, base + 4)[0] if base + 8 <= len(raw) else 0
    for k in range(count if count <= 100 else 0):
        if base + 16 + 8 * k > len(raw):
            return
        key, offset = struct.unpack_from("<II", raw, base + 8 + 8 * k)
        at = base + offset
        if key not in _SUMMARY or at + 8 > len(raw):
            continue
        kind, n = struct.unpack_from("<II", raw, at)
        wide = kind == 0x1F
        if kind in (0x1E, 0x1F) and 0 < n <= 10_000 and at + 8 + n * (1 + wide) <= len(raw):
            text = raw[at + 8 : at + 8 + n * (1 + wide)].decode("utf-16-le" if wide else "utf-8", "replace").rstrip("\0").strip()
            if text:
                yield row("meta", text=text, name=_SUMMARY[key])


def hwp(content: bytes) -> Iterator[Row]:
    try:
        files = streams(content)
    except BadCompoundFile as e:
        raise Unreadable(f"복합 파일을 열지 못했습니다: {e}") from e
    head = files.get("FileHeader")
    if not head:
        raise Unreadable("FileHeader가 들어 있지 않습니다")
    if len(head) < 40:
        raise Unreadable("FileHeader가 40바이트보다 짧습니다")
    if head[:32].decode("utf-8", "replace").rstrip("\0") != "HWP Document File":
        raise Unreadable("HWP의 시그니처가 아닙니다")
    flags = struct.unpack_from("<I", head, 36)[0]
    if flags & ENCRYPTED:
        raise Unreadable("암호화된 문서라 읽지 못합니다")
    if flags & DRM:
        raise Unreadable("DRM이 걸린 문서라 읽지 못합니다")
    compressed, distributed = bool(flags & COMPRESSED), bool(flags & DISTRIBUTION)
    folder = "ViewText" if distributed else "BodyText"
    sections: list[bytes] = []
    parts = list(itertools.takewhile(files.get, (f"{folder}/Section{k}" for k in range(MAX_SECTIONS))))
    if not parts:  # some writers put them elsewhere
        parts = sorted((n for n in files if re.search(r"Section\d+$", n)), key=lambda n: (int(re.search(r"\d+$", n)[0]), n))[:MAX_SECTIONS]
    for raw in (files[n] for n in parts):
        if distributed:
            try:
                raw = open_distributed(raw, compressed)
            except Unreadable:
                raise
            except Exception:
                break
        sections.append(raw)
    if not sections:
        raise Unreadable("읽을 섹션을 찾을 수 없는 문서입니다")
    yield row("meta", text=str(len(sections)), name="page_count")
    yield row("meta", text=f"{head[35]}.x", name="version")
    yield from _summary(files)
    try:
        raw = files.get("DocInfo", b"")
        info = list(read_records(inflate(raw) if compressed and raw else raw))
    except Unreadable:
        raise
    except Exception:
        info = []
    yield from _shapes(info)
    items = _items(info, files, compressed)
    room, nested = MAX_INFLATED, [0]
    for i, raw in enumerate(sections):
        try:
            body = inflate(raw, room) if compressed and not distributed else raw
            room -= len(body)
            if room < 0:
                raise Unreadable("압축 해제 한도를 넘는 문서입니다")
            found = list(_Section(i, nested, items).rows(tree(read_records(body))))
        except Unreadable:
            raise
        except Exception as e:
            yield row("warning", i, text=f"섹션 {i + 1}을 끝까지 읽지 못했습니다: {e}", code="PARTIAL_PARSE")
            continue
        yield from found
