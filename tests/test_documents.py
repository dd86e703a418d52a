"""HWP 3, HWPX and DOCX documents of the sample writers: notes, links, nested tables, images and damaged files."""

import struct

import pytest

from paperloom.plans import convert
from paperloom.sources import decode, hwp3, samples, scan
from paperloom.sources.hwpx import _local_files

PNG = b"\x89PNG\r\n\x1a\n" + bytes(50)


def decoded(spark, *blobs):
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "doc_id long, content binary")
    return decode.decode(scan.detect(docs))


def markdown(spark, *blobs):
    return [(r["success"], r["markdown"] if r["success"] else r["code"]) for r in convert.results(decoded(spark, *blobs)).orderBy("doc_id").collect()]


def test_every_syllable_is_read_and_a_wrong_final_letter_left_out():
    for c in map(chr, range(0xAC00, 0xD7A4)):
        assert hwp3.johab(int.from_bytes(c.encode("johab"), "big")) == c
    ga = int.from_bytes("가".encode("johab"), "big")
    assert {hwp3.johab(ga & ~31 | final) for final in (0, 18, 30, 31)} == {"가"}
    assert [hwp3.johab(x) for x in (0x41, 0x80, 0x7FFF, 0xFFFF)] == ["A", "", "", ""]


def units(*codes: int) -> bytes:
    return struct.pack(f"<{len(codes)}H", *codes)


def test_hwp3_tables_come_before_their_paragraph_and_texts_stay_as_they_are(spark):
    table = samples.hwp3_table(["칸", "둘"], "그림말")
    last = samples.hwp3_paragraph(units(ord("a"), 9, ord("b"), 24, 0, 0, 13, ord("c")) + table, True, 8 + 4)
    blobs = [samples.hwp3(["제1장 총칙", "~물결~ [별표 1]"], "제목", packed, last=last) for packed in (True, False)]
    want = "제1장 총칙\n\n~물결~ [별표 1]\n\n칸\n\n둘\n\n그림말\n\na\tb-\nc"
    assert markdown(spark, *blobs, samples.hwp3(["글"], locked=True), blobs[0][:-10], samples.hwp3([])) == [(True, want), (True, want), (False, "PARSE_ERROR"), (False, "DECOMPRESSION_BOMB"), (True, "")]
    (meta,) = convert.metadata(decoded(spark, blobs[0])).collect()
    assert (meta.title, meta.version, meta.author, meta.keywords) == ("제목", "3.0", None, [])


def test_hwp3_damaged_streams_keep_what_came_before():
    whole = samples.hwp3(["one", "two"], packed=False)
    for cut in range(len(whole) - 43, 1200, -7):
        kinds = [r["text"] for r in hwp3.hwp3(whole[:cut]) if r["kind"] == "paragraph"]
        assert kinds in (["one", "two"], ["one"], [])
    bad = samples.hwp3(["one"], packed=False, last=samples.hwp3_paragraph(samples.hwp3_table(["x"] * 257), True, 4))
    rows = list(hwp3.hwp3(bad))
    assert [r["attrs"]["code"] for r in rows if r["kind"] == "warning"] == ["PARTIAL_PARSE"]


CELL = "<hp:tc><hp:subList>{}</hp:subList></hp:tc>"
P = "<hp:p><hp:run><hp:t>{}</hp:t></hp:run></hp:p>"


def hwpx_table(*rows):
    return "<hp:tbl>" + "".join("<hp:tr>" + "".join(CELL.format(c if c.startswith("<") else P.format(c)) for c in r) + "</hp:tr>" for r in rows) + "</hp:tbl>"


@pytest.mark.parametrize("wrap", ["{}", "<hp:p><hp:run>{}</hp:run></hp:p>"])
def test_hwpx_nested_tables(spark, wrap):
    large, small = hwpx_table(["n1", "n2"], ["a", "b"], ["c", "d"]), hwpx_table(["s|1", "s2"])
    inner = hwpx_table(["x", "y"], [P.format("앞") + wrap.format(large), "z"], ["k", wrap.format(small)])
    ((_, got),) = markdown(spark, samples.hwpx(["글"], inner=inner))
    big = "| n1 | n2 |\n| --- | --- |\n| a | b |\n| c | d |"
    # a table that stands in a paragraph is always a block of its own
    small_block = "" if wrap == "{}" else "| s\\|1 | s2 |\n| --- | --- |\n\n"
    assert got.startswith(f"글\n\n{big}\n\n{small_block}| x | y |\n| --- | --- |\n| 앞<br>[중첩 테이블 #1: n1 \\| n2] | z |\n| k |"), got
    assert got.count("[중첩 테이블 #2: s\\|1 \\| s2]") + got.count("[중첩 테이블 #2: s\\\\|1 \\| s2]") >= 1, got


def test_hwpx_links_notes_tabs_equations_and_boxes(spark):
    inner = (
        "<hp:p><hp:run><hp:t>가<hp:tab/>나</hp:t><hp:ctrl><hp:footNote><hp:subList>" + P.format("각주") + "</hp:subList></hp:footNote></hp:ctrl></hp:run>"
        '<hp:hyperlink url="https://example.org/"><hp:t>다</hp:t></hp:hyperlink></hp:p>'
        '<hp:p><hp:run><hp:t>차례<hp:tab leader="3"/>12</hp:t></hp:run></hp:p>'
        "<hp:p><hp:run><hp:equation><hp:script>{a} over {b}</hp:script></hp:equation></hp:run></hp:p>"
        "<hp:p><hp:run><hp:rect><hp:drawText><hp:subList>" + P.format("상자") + "</hp:subList></hp:drawText></hp:rect></hp:run></hp:p>"
        '<hp:p><hp:run><hp:hyperlink url="javascript:x"><hp:t>라</hp:t></hp:hyperlink></hp:run></hp:p>'
    )
    ((_, got),) = markdown(spark, samples.hwpx([], inner=inner))
    assert got == "[가 나다](https://example.org/) (주: 각주)\n\n차례\n\n$\\frac{ a } { b }$\n\n상자\n\n라"


def test_hwpx_images(spark):
    pic = lambda ref: f'<hp:p><hp:run><hp:pic><hp:img binaryItemIDRef="{ref}"/></hp:pic></hp:run></hp:p>'
    more = {"BinData/image10.png": b"ten", "BinData/image1.JPG": b"one", "Contents/BinData/x.svg": b"svg"}
    rows = decoded(spark, samples.hwpx(["글"], inner=pic("image1") + pic("gone") + pic("x.svg") + pic("../x") + "<hp:pic/>", more=more))
    found = [(r["name"], r["mime_type"], r["filename"], r["data"] and bytes(r["data"])) for r in convert.images(rows).orderBy("ord").collect()]
    assert found == [("image1", "image/jpeg", "image_001.jpg", b"one"), ("gone", None, None, None), ("x.svg", "image/svg+xml", "image_002.svg", b"svg"), ("../x", None, None, None)]
    (got,) = convert.results(rows).collect()
    assert got.markdown == "글\n\n\n![image](image_001.jpg)\n\n[이미지: gone]\n\n\n![image](image_002.svg)\n\n[이미지: ../x]"
    assert [w.code for w in convert.warnings(rows).collect()] == ["SKIPPED_IMAGE"] * 3


def test_docx_images_stand_apart_and_controls_are_read(spark):
    inner = '<w:sdt><w:sdtContent><w:p><w:r><w:t>안</w:t><w:tab/><w:t>쪽</w:t></w:r></w:p></w:sdtContent></w:sdt><w:p><w:r><w:drawing><blip embed="r1"/></w:drawing></w:r></w:p>'
    more = {"word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="media/a.png"/></Relationships>', "word/media/a.png": PNG}
    rows = decoded(spark, samples.docx(["글"], inner=inner, more=more))
    assert [(r["filename"], bytes(r["data"])) for r in convert.images(rows).collect()] == [("image_001.png", PNG)]
    assert [r.markdown for r in convert.results(rows).collect()] == ["글\n\n안\t쪽"]


def test_broken_zip_files_and_protected_ones(spark):
    whole = samples.hwpx(["제1장 머리", "글"], frozenset([0]))
    cut = whole[: whole.index(b"PK\x01\x02")]
    locked = samples.hwpx(["글"], more={"META-INF/manifest.xml": "<m><encryption-data/></m>"})
    assert [name for name, _ in _local_files(cut)] == ["Contents/section0.xml"]
    rows = decoded(spark, whole, cut, cut[: cut.index(b"Contents/section0")], locked)
    got = [(r.success, r.markdown, r.code, r.page_count) for r in convert.results(rows).orderBy("doc_id").collect()]
    assert got == [(True, "### 제1장 머리\n\n글", None, 1), (True, "제1장 머리\n\n글", None, None), (False, None, "CORRUPTED", None), (False, None, "ENCRYPTED", None)]
    assert {w.code for w in convert.warnings(rows).where("doc_id = 1").collect()} == {"BROKEN_ZIP_RECOVERY"}
