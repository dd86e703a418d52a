"""Compound-file formats, equations and page selection against files of the sample writers."""

import struct

import pytest

from paperloom.functions.equation import office_math_latex, script_latex
from paperloom.plans import convert
from paperloom.sources import aes, biff, cfb, decode, hwp5, samples, scan
from paperloom.sources.xmltree import parse

PNG = b"\x89PNG\r\n\x1a\n" + bytes(5000)


def convert_all(spark, *blobs, pages=None):
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "doc_id long, content binary")
    return [r.asDict() for r in convert.parse(docs, pages).orderBy("doc_id").collect()]


def test_compound_file_gives_back_small_and_large_streams():
    files = {"A/x": b"1" * 100, "A/y": b"2" * 9000, "z": b"3" * 5000, "empty": b""}
    assert cfb.streams(samples.compound(files)) == files


@pytest.mark.parametrize("room", [20, 33, 64, 8224])
def test_shared_strings_across_records(room):
    texts = ["가나다라마바사", "plain text", "x" * 50, "é", "끝"]
    rows = list(biff.xls(samples.xls("s", [texts], (), room)))
    assert [r["text"] for r in rows if r["kind"] == "string"] == texts


def test_decryption_of_the_standards_example():
    assert aes.decrypt(bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a"), bytes(range(16))) == bytes.fromhex("00112233445566778899aabbccddeeff")


@pytest.mark.parametrize(
    ("script", "latex"),
    [
        ("{a} over {b}", r"\frac{ a } { b }"), ("{{1} over {2}} over {3}", r"\frac{ \frac{ 1 } { 2 } } { 3 }"), ("sqrt {x}", r"\sqrt { x }"), ("root {3} of {x}", r"\sqrt[ 3 ]{ x }"),
        ("{pmatrix{a & b # c & d}}", "\\begin{pmatrix} a & b  \\\\  c & d \\end{pmatrix}"), ("{bar {x}}", r"\overline{ x }"), ("OVERBRACE {a} {b}", r"\overbrace{ a }^{ b }"),
        ("LEFT { x RIGHT }", r"\left \{ x \right \}"), ("alpha`+ OMEGA", r"\alpha + \Omega"), ("}{", "} {"), ("", ""), ("x over y", "x over y"),
    ],
)
def test_equation_scripts(script, latex):
    assert script_latex(script) == latex


def test_office_math():
    text = lambda s: f"<r><t>{s}</t></r>"
    xml = f"<oMath><f><num>{text('a')}</num><den><rad><deg>{text(3)}</deg><e>{text('b')}</e></rad></den></f><sSubSup><e>{text('x')}</e><sub>{text('i')}</sub><sup>{text(2)}</sup></sSubSup><d><e>{text('y')}</e></d></oMath>"
    assert office_math_latex(parse(xml)) == r"\frac{a}{\sqrt[3]{b}}{x}_{i}^{2}\left(y\right)"


def control(name: bytes, level: int, inner: bytes = b"") -> bytes:
    return samples.record(0x47, level, name + bytes(12)) + inner


def test_hwp_paragraphs_tables_pictures_links_and_equations(spark):
    script = "{a} over {b}".encode("utf-16-le")
    equation = control(b"deqe", 1, samples.record(0x58, 2, bytes(4) + struct.pack("<H", len(script) // 2) + script))
    mark = "\x0b" + struct.pack("<I", int.from_bytes(b"deqe", "little")).decode("utf-16-le") + "\0" * 4 + "\x0b"
    picture = control(b" osg", 1, samples.record(0x55, 3, bytes(71) + struct.pack("<H", 1)))
    missing = control(b" osg", 1, samples.record(0x55, 3, bytes(71) + struct.pack("<H", 9)))
    link = samples.record(0x47, 1, b"klh%" + bytes(5) + "https\\://example.org/a;1;0;0;\0".replace("\\", "").encode("utf-16-le"))
    body = samples.hwp(["머리", "보통 글", f"값 {mark} 이다"], frozenset([0]), equation + link + picture + missing + samples.hwp_table([["a", "b"], ["c", "d"]]), pictures=(PNG,))
    (got,) = convert_all(spark, body)
    assert got["success"] and got["file_type"] == "hwp" and got["page_count"] == 1
    assert got["markdown"] == "# 머리\n\n보통 글\n\n[값 $\\frac{ a } { b }$ 이다](https://example.org/a)\n\n\n![image](image_001.png)\n\n[이미지: BinData 9]\n\n| a | b |\n| --- | --- |\n| c | d |"
    rows = decode.decode(scan.detect(spark.createDataFrame([(1, bytearray(body))], "doc_id long, content binary")))
    assert [(r["filename"], bytes(r["data"])) for r in convert.images(rows).where("filename IS NOT NULL").collect()] == [("image_001.png", PNG)]
    assert [r["code"] for r in convert.warnings(rows).collect()] == ["SKIPPED_IMAGE"]


def test_unreadable_hwp_files_get_their_codes(spark):
    flags = [1 | hwp5.ENCRYPTED, 1 | hwp5.DRM, 1 | hwp5.DISTRIBUTION, 0]
    got = convert_all(spark, *[samples.hwp(["글"], flags=f) for f in flags])
    assert [r["code"] for r in got] == ["ENCRYPTED", "DRM_PROTECTED", "NO_SECTIONS", None]
    assert got[3]["markdown"] == "글"


def test_distribution_sections_open_with_the_key_that_they_hide():
    # AES with a key of zeros turns this block into zeros; an unpacked section of zero bytes has no use, so the bytes are compared
    cipher = bytes.fromhex("66e94bd4ef8a2c3b884cfa59ca342b2e")
    seed, key_at = 7, 4
    mask, state = [], seed

    def rand():
        nonlocal state
        state = (state * 214013 + 2531011) % (1 << 32)
        return state >> 16 & 0x7FFF

    while len(mask) < 256:
        byte = rand() & 0xFF
        mask += [byte] * ((rand() & 15) + 1)
    # the key stands at 4 plus the low bits of the first byte, which stays as it is
    key_at += seed & 15
    plain = bytearray(256)
    payload = struct.pack("<I", seed) + bytes(p ^ m for p, m in zip(plain[4:], mask[4:256], strict=True))
    assert hwp5.open_distributed(samples.record(0x1C, 0, payload) + cipher, False) == bytes(16)


def test_nested_tables_and_spans(spark):
    inner = samples.hwp_table([["n1", "n2"]], 3)
    cell = lambda r, c, high, wide, content: samples.record(0x48, 2, struct.pack("<IIHHHH", 1, 0, c, r, wide, high)) + content
    table = samples.record(0x47, 1, b" lbt" + bytes(12)) + samples.record(0x4D, 2, struct.pack("<IHH", 0, 2, 2))
    table += cell(0, 0, 1, 2, samples.hwp_paragraph("위", 2)) + cell(1, 0, 1, 1, samples.hwp_paragraph("앞", 2, inner=inner)) + cell(1, 1, 1, 1, samples.hwp_paragraph("d", 2))
    (got,) = convert_all(spark, samples.hwp(["글"], inner=table))
    assert got["markdown"] == '글\n\n<table>\n<tr><th colspan="2">위</th></tr>\n<tr><td>앞<br>[중첩 테이블 #1]<br>n1<br>n2</td><td>d</td></tr>\n</table>'


def test_pages_choose_sheets_and_sections(spark):
    book, text = samples.xls("one", [["a", "b"]]), samples.docx(["글"])
    chosen = convert_all(spark, book, text, pages="1")
    assert [r["markdown"] for r in chosen] == ["## one\n\n| a | b |\n| --- | --- |", "글"]
    assert [r["markdown"] for r in convert_all(spark, book, text, pages="9")] == [r["markdown"] for r in chosen]
