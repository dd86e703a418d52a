"""Decoding of HWP 3.x: a fixed head, then one stream of paragraphs in the combined Johab code."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import takewhile

from paperloom.sources.rows import Row, Unreadable, row

HEAD, INFO, SUMMARY_FIELD = 30, 128, 112
MAX_BODY = 100 << 20
#: A paragraph beyond these, or a table beyond that many cells, is a sign of a damaged stream.
MAX_CHARS, MAX_LINES, MAX_CELLS = 60_000, 4096, 256
MAX_PICTURE = 100 << 20
#: Units that are looked at together, and whether a unit is a letter.
RUN, PLAIN = 256, (31).__lt__

#: Control codes within a line, the units of two bytes behind each, and the text it stands for.
INLINE = {
    7: (3, "￼"), 8: (3, "￼"), 9: (0, "\t"), 18: (3, " "), 19: (3, "￼"), 20: (3, "￼"), 21: (3, "￼"), 22: (11, "￼"),
    23: (4, "￼"), 24: (2, "-"), 25: (2, "-"), 26: (122, "￼"), 28: (31, "￼"), 30: (1, " "), 31: (1, " "),
}
#: Bytes of the objects that only have a fixed head, and of those with a list of paragraphs behind it.
PLAIN_OBJECTS = {12: 84, 14: 84}
TEXT_OBJECTS = {15: 8, 16: 10, 17: 14}
#: The parts of the head's summary that are kept, in file order.
SUMMARY = ("title", "description", "author", "created_at")


@cache
def johab(code: int) -> str:
    """The character of one unit; a syllable with a final letter that does not exist is read without it."""
    if code < 0x80:
        return chr(code)
    try:
        return code.to_bytes(2, "big").decode("johab") if code >= 0x8000 else ""
    except UnicodeDecodeError:
        pass
    try:
        open_syllable = (code & ~0x1F | 1).to_bytes(2, "big").decode("johab")
    except UnicodeDecodeError:
        return ""
    return open_syllable if "가" <= open_syllable <= "힣" else ""


def _summary(raw: bytes) -> str:
    units = struct.unpack(f"<{len(raw) // 2}H", raw)
    return "".join(map(johab, units[: units.index(0)] if 0 in units else units))


class _Body:
    """A cursor over the stream.  Texts of tables and notes come before the paragraph that holds them."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0
        self.texts: list[str] = []
        self.warnings: dict[str, str] = {}

    def skip(self, n: int) -> None:
        if self.at + n > len(self.raw):
            raise Unreadable("데이터가 모자랍니다")
        self.at += n

    def take(self, form: str) -> tuple:
        begin = self.at
        self.skip(struct.calcsize(form))
        return struct.unpack_from(form, self.raw, begin)

    def read(self) -> None:
        try:
            for _ in range(7):  # the fonts of each script
                self.skip(self.take("<H")[0] * 40)
            self.skip(self.take("<H")[0] * 238)  # styles
            self.paragraphs()
        except (Unreadable, RecursionError) as e:
            self.warnings.setdefault("PARTIAL_PARSE", f"HWP3 본문을 끝까지 읽지 못했습니다: {e}")

    def paragraphs(self) -> None:
        """One list up to its empty last paragraph; a damaged text ends the list."""
        while self.at < len(self.raw):
            follows, chars = self.take("<BH")
            if chars == 0:
                return self.skip(40)
            lines, shaped = self.take("<HB")
            if chars > MAX_CHARS or lines > MAX_LINES:
                self.warnings.setdefault("PARTIAL_PARSE", f"HWP3 문단이 비정상입니다: 글자 {chars}, 줄 {lines}")
                return None
            self.skip(37 + (0 if follows else 187) + 14 * lines)
            for _ in range(chars if shaped else 0):
                if self.take("<B")[0] != 1:
                    self.skip(31)
            try:
                self.texts.append(self.line(chars))
            except Unreadable as e:
                self.warnings.setdefault("PARTIAL_PARSE", f"HWP3 문단 {len(self.texts) + 1}: {e}")
                return None
        return None

    def line(self, left: int) -> str:
        out: list[str] = []
        while left > 0:
            n = min(left, RUN, (len(self.raw) - self.at) // 2)
            if run := list(takewhile(PLAIN, struct.unpack_from(f"<{n}H", self.raw, self.at))):
                out += map(johab, run)
                self.at += 2 * len(run)
                left -= len(run)
                continue
            (code,) = self.take("<H")
            left -= 1
            if code == 13:
                out.append("\n")
            elif code in INLINE:
                units, shown = INLINE[code]
                self.skip(2 * units)
                left -= units
                out.append(shown)
            elif code:
                size, _ = self.take("<IH")
                left -= 3
                self.object(code, size)
        return "".join(out).strip()

    def object(self, code: int, size: int) -> None:
        if code == 10:  # a table, text box, equation or button
            cells = struct.unpack("<H", self.take("<84s")[0][80:82])[0] or 1
            if cells > MAX_CELLS:
                raise Unreadable(f"표의 칸 수가 비정상입니다: {cells}")
            self.skip(27 * cells)
            for _ in range(cells + 1):  # and the caption
                self.paragraphs()
        elif code == 11:
            (more,) = self.take("<I344x")
            self.skip(more if more < MAX_PICTURE else 0)
        elif code in PLAIN_OBJECTS:
            self.skip(PLAIN_OBJECTS[code])
        elif code in TEXT_OBJECTS:
            self.skip(TEXT_OBJECTS[code])
            self.paragraphs()
        elif code == 29:
            self.skip(size if size < 1_000_000 else 0)
        else:
            self.warnings.setdefault("UNSUPPORTED_ELEMENT", f"HWP3 제어 문자 {code}")


def hwp3(content: bytes) -> Iterator[Row]:
    """Paragraph rows are ``plain``: their text is shown as it is."""
    start = HEAD + INFO + 9 * SUMMARY_FIELD
    if len(content) < start:
        raise Unreadable("HWP3 머리 부분이 잘렸습니다")
    (locked,) = struct.unpack_from("<H", content, HEAD + 96)
    packed, more = struct.unpack_from("<BxH", content, HEAD + 124)
    if locked:
        raise Unreadable("HWP3 본문이 암호로 잠겨 있습니다")
    if start + more > len(content):
        raise Unreadable("HWP3 정보 블록이 잘렸습니다")
    yield row("meta", text="3.0", name="version")
    for k, name in enumerate(SUMMARY):
        at = HEAD + INFO + k * SUMMARY_FIELD
        if text := _summary(content[at : at + SUMMARY_FIELD]):
            yield row("meta", text=text, name=name)
    raw = content[start + more :]
    if packed:
        unzip = zlib.decompressobj(-15)
        try:
            raw = unzip.decompress(raw, MAX_BODY)
        except zlib.error as e:
            raise Unreadable(f"HWP3 본문의 압축 해제가 멈췄습니다: {e}") from e
        if not unzip.eof and not unzip.unconsumed_tail:
            raise Unreadable("HWP3 본문의 압축 해제가 중간에 끝났습니다")
        if unzip.unconsumed_tail:
            raise Unreadable("HWP3 본문의 압축 해제 한도를 넘었습니다")
    body = _Body(raw)
    body.read()
    for i, text in enumerate(body.texts):
        yield row("paragraph", ord=i, text=text, plain=1)
    for code, text in body.warnings.items():
        yield row("warning", text=text, code=code)
