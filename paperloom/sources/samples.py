"""Small writers of each container, independent of the decoders; queries and tests read back what they make."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from functools import cache
from xml.sax.saxutils import escape, quoteattr


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _letters(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, r = divmod(c - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(name: str, rows: list[list[object]], merges: tuple[str, ...] = ()) -> bytes:
    strings: dict[str, int] = {}
    lines = []
    for r, values in enumerate(rows):
        cells = ""
        for c, v in enumerate(values):
            ref = f"{_letters(c)}{r + 1}"
            if isinstance(v, str):
                cells += f'<c r="{ref}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
            elif v is not None:
                cells += f'<c r="{ref}"><v>{v}</v></c>'
        lines.append(f'<row r="{r + 1}">{cells}</row>')
    merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return _zip({
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}>{''.join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData><mergeCells>{merged}</mergeCells></worksheet>",
    })


def docx(paragraphs: list[str], headings: frozenset[int] = frozenset(), inner: str = "", more: dict[str, str | bytes] | None = None) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    style = '<w:pPr><w:pStyle w:val="H1"/></w:pPr>'
    body = "".join(f'<w:p>{style if i in headings else ""}<w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for i, p in enumerate(paragraphs))
    return _zip({
        "word/document.xml": f"<w:document {w}><w:body>{body}{inner}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H1"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>',
        **(more or {}),
    })


def hwpml(paragraphs: list[str], headings: frozenset[int] = frozenset()) -> bytes:
    body = "".join(f'<P ParaShape="{1 if i in headings else 0}"><TEXT><CHAR>{escape(p)}</CHAR></TEXT></P>' for i, p in enumerate(paragraphs))
    shape = '<HEAD><MAPPINGTABLE><PARASHAPELIST><PARASHAPE Id="1" HeadingType="Outline" Level="0"/></PARASHAPELIST></MAPPINGTABLE></HEAD>'
    return f'<?xml version="1.0" encoding="UTF-8"?><HWPML>{shape}<BODY><SECTION>{body}</SECTION></BODY></HWPML>'.encode()


def hwpx(paragraphs: list[str], headings: frozenset[int] = frozenset(), inner: str = "", more: dict[str, str | bytes] | None = None) -> bytes:
    """``inner`` goes behind the paragraphs as it is, and ``more`` into the ZIP file."""
    body = "".join(f'<hp:p><hp:run charPrIDRef="{1 if i in headings else 0}"><hp:t>{escape(p)}</hp:t></hp:run></hp:p>' for i, p in enumerate(paragraphs))
    return _zip({
        "mimetype": "application/hwp+zip",
        "Contents/content.hpf": '<package><manifest><item id="section0" href="Contents/section0.xml"/></manifest><spine><itemref idref="section0"/></spine></package>',
        "Contents/header.xml": '<head><charPr id="0" height="1000"/><charPr id="1" height="1600"/></head>',
        "Contents/section0.xml": f'<hs:sec xmlns:hs="s" xmlns:hp="p">{body}{inner}</hs:sec>',
        **(more or {}),
    })


def compound(files: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams below 4096 bytes go to the mini stream."""
    none, end, fat_mark = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
    pad = lambda raw, n: raw + bytes(-len(raw) % n)
    small = {p: d for p, d in files.items() if 0 < len(d) < 4096}
    mini, mini_fat, start = b"", [], {}
    for p, d in small.items():
        start[p], n = len(mini_fat), -(-len(d) // 64)
        mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), end]
        mini += pad(d, 64)
    folders = sorted({"/".join(p.split("/")[:k]) for p in files for k in range(1, p.count("/") + 1)})
    names = ["", *folders, *files]
    parent = {x: x.rpartition("/")[0] for x in names[1:]}
    kids = {x: [names.index(k) for k, up in parent.items() if up == x] for x in names}
    sectors, fat = [], []

    def put(raw: bytes) -> int:
        if not raw:
            return end
        first, n = len(sectors), -(-len(raw) // 512)
        sectors.extend(pad(raw, 512)[512 * k : 512 * (k + 1)] for k in range(n))
        fat.extend([*range(first + 1, first + n), end])
        return first

    for p, d in files.items():
        if len(d) >= 4096:
            start[p] = put(d)
    mini_at = put(mini)
    mini_fat_at = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) // 128) * 512, b"\xff"))
    directory = b""
    for i, x in enumerate(names):
        name = (x.rpartition("/")[2] if i else "Root Entry").encode("utf-16-le") + b"\0\0"
        # siblings hang on each other's right side
        beside = kids[parent[x]] if i else [0]
        at = beside.index(i)
        right = beside[at + 1] if at + 1 < len(beside) else none
        kind, begin, size = (5, mini_at, len(mini)) if i == 0 else (2, start.get(x, end), len(files[x])) if x in files else (1, 0, 0)
        directory += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name), kind, 1, none, right, kids[x][0] if kids[x] else none) + bytes(36) + struct.pack("<IQ", begin, size)
    directory_at = put(directory.ljust(-(-len(directory) // 512) * 512, b"\0"))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    fat_sectors = list(range(len(sectors), len(sectors) + n_fat))
    table = struct.pack(f"<{len(fat) + n_fat}I", *fat, *[fat_mark] * n_fat).ljust(n_fat * 512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIIII", n_fat, directory_at, 0, 4096, mini_fat_at, -(-len(mini_fat) // 128), end, 0, fat_sectors[0])
    return head.ljust(80, b"\0") + struct.pack(f"<{n_fat - 1}I", *fat_sectors[1:]).ljust(432, b"\xff") + b"".join(sectors) + table


def _biff(op: int, data: bytes) -> bytes:
    return struct.pack("<HH", op, len(data)) + data


def xls(name: str, rows: list[list[object]], merges: tuple[tuple[int, int, int, int], ...] = (), room: int = 8224) -> bytes:
    """A BIFF8 workbook of one sheet; the shared strings go on in a new record after ``room`` bytes."""
    strings: dict[str, int] = {}
    cells = b""
    for r, values in enumerate(rows):
        for c, v in enumerate(values):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, bool):
                cells += _biff(0x205, at + bytes([v, 0]))
            elif isinstance(v, str):
                cells += _biff(0xFD, at + struct.pack("<I", strings.setdefault(v, len(strings))))
            elif isinstance(v, int) and abs(v) < 1 << 29:
                cells += _biff(0x27E, at + struct.pack("<i", v << 2 | 2))
            elif v is not None:
                cells += _biff(0x203, at + struct.pack("<d", v))
    pieces, body = [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        raw, width = (s.encode("latin-1"), 1) if all(ord(ch) < 256 for ch in s) else (s.encode("utf-16-le"), 2)
        if len(body) + 5 > room:  # a first character stays with its head
            pieces.append(body)
            body = b""
        body += struct.pack("<HB", len(raw) // width, width - 1)
        while raw:
            fits = (room - len(body)) // width * width
            if fits <= 0:
                pieces.append(body)
                body = bytes([width - 1])
                continue
            body, raw = body + raw[:fits], raw[fits:]
    pieces.append(body)
    table = _biff(0xFC, pieces[0]) + b"".join(_biff(0x3C, p) for p in pieces[1:])
    title = name.encode("utf-16-le")
    bof = lambda kind: _biff(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    sheet = lambda at: _biff(0x85, struct.pack("<IBBBB", at, 0, 0, len(title) // 2, 1) + title)
    merged = _biff(0xE5, struct.pack("<H", len(merges)) + b"".join(struct.pack("<4H", r1, r2, c1, c2) for r1, c1, r2, c2 in merges))
    head_size = len(bof(5) + sheet(0) + table) + 4
    return compound({"Workbook": bof(5) + sheet(head_size) + table + _biff(0x0A, b"") + bof(0x10) + cells + merged + _biff(0x0A, b"")})


@cache
def _johab_unit(ch: str) -> bytes:
    return struct.pack("<H", ord(ch)) if ord(ch) < 128 else ch.encode("johab", "ignore")[::-1]


def _johab(text: str) -> bytes:
    return b"".join(map(_johab_unit, text))


def hwp3_paragraph(units: bytes, follows: bool = False, chars: int | None = None) -> bytes:
    """A paragraph of encoded ``units``, which count as ``chars``; none ends a list."""
    n = len(units) // 2 if chars is None else chars
    return struct.pack("<BHHB", follows, n, 1, 0) + bytes(37 + (0 if follows else 187) + 14) + units if n else bytes(43)


def hwp3_table(cells: list[str], caption: str = "") -> bytes:
    """The units of a table in a paragraph; they count as four."""
    lists = b"".join(hwp3_paragraph(_johab(x)) + hwp3_paragraph(b"") for x in [*cells, caption])
    return struct.pack("<HIH", 10, 0, 10) + bytes(80) + struct.pack("<HH", len(cells), 0) + bytes(27 * len(cells)) + lists


def hwp3(paragraphs: list[str], title: str = "", packed: bool = True, locked: bool = False, last: bytes = b"") -> bytes:
    """``last`` is a paragraph that is put in as it is."""
    body = struct.pack("<7H", *[1] * 7).replace(b"\1\0", b"\1\0" + bytes(40)) + struct.pack("<H", 2) + bytes(2 * 238)
    body += b"".join(hwp3_paragraph(_johab(p), i > 0) for i, p in enumerate(p for p in paragraphs if p.strip())) + last + hwp3_paragraph(b"")
    head = b"HWP Document File V3.00 \x1a\1\2\3\4\5" + bytes(96) + struct.pack("<H", locked) + bytes(26) + struct.pack("<BBH", packed, 0, 6)
    deflate = zlib.compressobj(wbits=-15)
    return head + _johab(title)[:110].ljust(9 * 112, b"\0") + bytes(6) + (deflate.compress(body) + deflate.flush() if packed else body)


def record(tag: int, level: int, data: bytes) -> bytes:
    small = len(data) < 0xFFF
    return struct.pack("<I", tag | level << 10 | (len(data) if small else 0xFFF) << 20) + (b"" if small else struct.pack("<I", len(data))) + data


def hwp_paragraph(text: str, level: int = 0, char: int = 0, shape: int = 0, inner: bytes = b"") -> bytes:
    """A paragraph record with its text, run shape and the records ``inner`` below it."""
    head = struct.pack("<IIHH", len(text) + 1, 0, shape, 0)
    text = text.replace("\t", "\t" + "\0" * 6 + "\t")  # a tab takes eight units
    return record(0x42, level, head) + record(0x43, level + 1, (text + "\r").encode("utf-16-le")) + record(0x44, level + 1, struct.pack("<II", 0, char)) + inner


def hwp_table(rows: list[list[str]], level: int = 1) -> bytes:
    out = record(0x47, level, b" lbt" + bytes(12)) + record(0x4D, level + 1, struct.pack("<IHH", 0, len(rows), max(map(len, rows))))
    for r, values in enumerate(rows):
        for c, v in enumerate(values):
            out += record(0x48, level + 1, struct.pack("<IIHHHH", 1, 0, c, r, 1, 1)) + hwp_paragraph(v, level + 1)
    return out


def hwp(paragraphs: list[str], headings: frozenset[int] = frozenset(), inner: bytes = b"", flags: int = 1, pictures: tuple[bytes, ...] = ()) -> bytes:
    """Character shape 0 has 10 and shape 1 has 16 points; ``inner`` goes below the last paragraph."""
    deflate = lambda raw: (z := zlib.compressobj(wbits=-15)).compress(raw) + z.flush() if flags & 1 else raw
    chars = b"".join(record(0x15, 1, bytes(42) + struct.pack("<II", size, 0)) for size in (100, 160))
    info = chars + record(0x19, 1, bytes(4)) + b"".join(record(0x12, 1, struct.pack("<HHH", 1, k + 1, 0)) for k in range(len(pictures)))
    body = b"".join(hwp_paragraph(p, 0, int(i in headings), 0, inner if i + 1 == len(paragraphs) else b"") for i, p in enumerate(paragraphs))
    head = b"HWP Document File".ljust(32, b"\0") + bytes([0, 0, 0, 5]) + struct.pack("<I", flags)
    files = {"FileHeader": head.ljust(256, b"\0"), "DocInfo": deflate(info), "BodyText/Section0": deflate(body)}
    return compound(files | {f"BinData/BIN{k + 1:04X}.png": deflate(p) for k, p in enumerate(pictures)})
