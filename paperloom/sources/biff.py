"""BIFF8 workbooks ([MS-XLS]): shared strings, cells and merged ranges as tagged rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from paperloom.sources.cfb import BadCompoundFile, streams
from paperloom.sources.rows import Row, Unreadable, row, truncated

MAX_RECORDS, MAX_SHEETS, MAX_ROWS, MAX_COLS = 1_000_000, 100, 100_000, 200
SHOWN_ROWS = 10_000  # of a sheet, from its first row that has text
BOF, EOF, CONTINUE, BOUNDSHEET, SST, FILEPASS = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x2F
NUMBER, RK, MULRK, LABELSST, LABEL, FORMULA, STRING, BOOLERR, MERGECELLS = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x06, 0x207, 0x205, 0xE5
GLOBALS, WORKSHEET = 0x05, 0x10
#: The error values of a cell.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}

Record = tuple[int, int, bytes]  # offset, opcode, data


def _records(book: bytes) -> list[Record]:
    out, at = [], 0
    while at + 4 <= len(book) and len(out) < MAX_RECORDS:
        op, size = struct.unpack_from("<HH", book, at)
        out.append((at, op, book[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _chars(raw: bytes, wide: int) -> str:
    return raw.decode("utf-16-le" if wide & 1 else "latin-1", "replace")


def _text(data: bytes, at: int, n: int) -> str:
    """n characters behind the flag byte at ``at``."""
    wide = data[at]
    return _chars(data[at + 1 : at + 1 + n * (2 if wide & 1 else 1)], wide)


class _Pieces:
    """A record's data and that of its continuations, read as one; where text is split, its flags come again."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.at = [p for p in parts if p], 0

    def raw(self, n: int) -> bytes:
        out = b""
        while n and self.parts:
            got = self.parts[0][self.at : self.at + n]
            out, n = out + got, n - len(got)
            self._forward(len(got))
        if n:
            raise EOFError
        return out

    def skip(self, n: int) -> None:
        while n > 0 and self.parts:
            step = min(n, len(self.parts[0]) - self.at)
            n -= step
            self._forward(step)

    def _forward(self, n: int) -> None:
        self.at += n
        if self.at >= len(self.parts[0]):
            self.parts.pop(0)
            self.at = 0

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.raw(3))
        runs = struct.unpack("<H", self.raw(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.raw(4))[0] if flags & 4 else 0
        out, fresh = [], False
        while n:
            if fresh:
                flags = self.raw(1)[0]
            if not self.parts:
                raise EOFError
            width = 2 if flags & 1 else 1
            here = min(n, (len(self.parts[0]) - self.at) // width)
            out.append(_chars(self.raw(here * width), flags))
            n, fresh = n - here, True
        self.skip(4 * runs + extra)
        return "".join(out)


def _shared_strings(records: list[Record]) -> Iterator[str]:
    first = next((i for i, (_, op, _) in enumerate(records) if op == SST), None)
    if first is None:
        return
    last = first + 1
    while last < len(records) and records[last][1] == CONTINUE:
        last += 1
    pieces = _Pieces([data for _, _, data in records[first:last]])
    try:
        pieces.skip(4)
        for _ in range(struct.unpack("<I", pieces.raw(4))[0]):
            yield pieces.string()
    except EOFError:
        return


def _rk(value: int) -> float:
    """30 bits of an integer or of a double's upper half, perhaps in hundredths."""
    number = float((value - (value >> 31 << 32)) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & ~3) << 32))[0]
    return number / 100 if value & 1 else number


def number_text(v: float) -> str:
    return str(int(v)) if v == int(v) else f"{v:.15g}"


def _formula(result: bytes, after: Record | None) -> tuple[str, str]:
    if result[6:8] != b"\xff\xff":
        return "str", number_text(struct.unpack("<d", result)[0])
    if result[0] == 0:
        data = after[2] if after and after[1] == STRING else b""
        return "str", _text(data, 2, struct.unpack_from("<H", data)[0]) if len(data) > 2 else ""
    if result[0] == 1:
        return "b", str(int(result[2] == 1))
    return "e", ERRORS.get(result[2], f"#ERR{result[2]}") if result[0] == 2 else ""


def _cells(records: list[Record], begin: int, section: int) -> Iterator[Row]:
    """The last value written to each cell, and the merged ranges."""
    found: dict[tuple[int, int], tuple[str, str]] = {}
    merges = []
    for i in range(begin, len(records)):
        _, op, data = records[i]
        if op in (EOF, BOF):
            break
        if op == MERGECELLS and len(data) >= 2:
            count = min(struct.unpack_from("<H", data)[0], (len(data) - 2) // 8)
            merges += [struct.unpack_from("<4H", data, 2 + 8 * k) for k in range(count)]
        if op not in (NUMBER, RK, MULRK, LABELSST, LABEL, FORMULA, BOOLERR) or len(data) < 6:
            continue
        r, c = struct.unpack_from("<HH", data)
        size = len(data)
        if op == NUMBER and size >= 14:
            found[r, c] = "str", number_text(struct.unpack_from("<d", data, 6)[0])
        elif op == RK and size >= 10:
            found[r, c] = "str", number_text(_rk(struct.unpack_from("<I", data, 6)[0]))
        elif op == MULRK:
            last = struct.unpack_from("<H", data, size - 2)[0]
            for k in range(min(last - c + 1, (size - 6) // 6)):
                found[r, c + k] = "str", number_text(_rk(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
        elif op == LABELSST and size >= 10:
            found[r, c] = "s", str(struct.unpack_from("<I", data, 6)[0])
        elif op == LABEL:
            found[r, c] = "str", _text(data, 8, struct.unpack_from("<H", data, 6)[0]) if size >= 9 else ""
        elif op == FORMULA and size >= 14:
            found[r, c] = _formula(data[6:14], records[i + 1] if i + 1 < len(records) else None)
        elif op == BOOLERR and size >= 8:
            found[r, c] = ("e", ERRORS.get(data[6], f"#ERR{data[6]}")) if data[7] == 1 else ("b", str(int(data[6] == 1)))
    for r1, r2, c1, c2 in merges:
        if r1 <= r2 and c1 <= c2 and r1 < MAX_ROWS and c1 < MAX_COLS:
            r2, c2 = min(r2, MAX_ROWS - 1), min(c2, MAX_COLS - 1)
            # a range reaches as far as its last cell, which need not be written
            found.setdefault((r2, c2), ("str", ""))
            yield row("merge", section, r1=r1, c1=c1, r2=r2, c2=c2)
    filled = [r for (r, c), (_, text) in found.items() if text and r < MAX_ROWS and c < MAX_COLS]
    end = min(filled, default=0) + SHOWN_ROWS
    beyond = sum(r >= end or c >= MAX_COLS for r, c in found)
    for (r, c), (kind, text) in found.items():
        if r < min(end, MAX_ROWS) and c < MAX_COLS:
            yield row("cell", section, r=r, c=c, text=text, type=kind)
    if beyond:
        yield truncated(section, beyond)


def xls(content: bytes) -> Iterator[Row]:
    try:
        files = streams(content)
    except BadCompoundFile as e:
        raise Unreadable(f"XLS 컨테이너의 시그니처가 다릅니다: {e}") from e
    book = files.get("Workbook") or files.get("Book")
    if not book:
        raise Unreadable("통합 문서가 들어 있지 않은 XLS입니다")
    records = _records(book)
    version, kind = struct.unpack_from("<HH", records[0][2].ljust(4, b"\0")) if records else (0, 0)
    if not records:
        raise Unreadable("빈 XLS 스트림에는 시그니처가 없습니다")
    if records[0][1] != BOF:
        raise Unreadable("XLS 스트림이 BOF로 시작하지 않습니다")
    if version != 0x600:
        raise Unreadable(f"BIFF8이 아닌 XLS입니다: 0x{version:04x}")
    if kind != GLOBALS:
        raise Unreadable("XLS의 전역 부분이 먼저 나오지 않습니다")
    end = next((i for i, (_, op, _) in enumerate(records) if op == EOF), len(records))
    head = records[:end]
    sheets = [data for _, op, data in head if op == BOUNDSHEET and len(data) >= 8]
    if any(op == FILEPASS for _, op, _ in head):
        yield row("meta", text=str(len(sheets)), name="page_count")
        yield row("warning", text="암호가 걸린 XLS라 셀을 읽지 않았습니다", code="PARTIAL_PARSE")
        return
    yield row("meta", text=str(min(len(sheets), MAX_SHEETS)), name="page_count")
    for i, text in enumerate(_shared_strings(head)):
        yield row("string", ord=i, text=text)
    begins = {offset: i for i, (offset, op, _) in enumerate(records) if op == BOF}
    spare = next((i for i in sorted(begins.values()) if i), None)
    for i, data in enumerate(sheets[:MAX_SHEETS]):
        name = _text(data, 7, data[6])
        if data[5]:
            continue  # a chart or macro sheet
        begin = begins.get(struct.unpack_from("<I", data)[0], spare)
        if begin is None:
            yield row("warning", i, text=f'시트 "{name}"의 자리가 비어 있습니다: {struct.unpack_from("<I", data)[0]}', code="PARTIAL_PARSE")
        elif records[begin][2][2:4] == struct.pack("<H", WORKSHEET):
            try:
                cells = list(_cells(records, begin + 1, i))
            except Exception as e:
                yield row("warning", i, text=f'시트 "{name}"을 끝까지 읽지 못했습니다: {e}', code="PARTIAL_PARSE")
                continue
            yield row("sheet", i, text=name)
            yield from cells
