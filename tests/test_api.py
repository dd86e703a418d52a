"""The Python interface, the command line, the stream, and files that are hard to read."""

import json

import pytest

import paperloom
from paperloom.__main__ import main
from paperloom.plans import convert
from paperloom.sources import decode, samples, scan
from paperloom.sources.xmltree import parse as parse_xml
from paperloom.streaming import watch


def test_parse_one_document(spark):
    told = []
    image = '<hp:p><hp:run><hp:pic><hp:img binaryItemIDRef="i1"/></hp:pic></hp:run></hp:p>'
    data = samples.hwpx(["head", "one", "two"], frozenset([0]), inner=image, more={"BinData/i1.png": b"\x89PNG", "META-INF/meta.xml": "<m><title>T</title></m>"})
    r = paperloom.parse(data, paperloom.ParseOptions(on_progress=lambda done, total: told.append((done, total))))
    assert isinstance(r, paperloom.ParseSuccess) and r.success and r.file_type == "hwpx"
    assert r.markdown == "# head\n\none\n\ntwo\n\n\n![image](image_001.png)"
    assert [(o.level, o.text) for o in r.outline] == [(1, "head")] and r.metadata.title == "T" and told == [(0, 1), (1, 1)]
    assert [(i.filename, i.mime_type, i.data) for i in r.images] == [("image_001.png", "image/png", b"\x89PNG")]
    assert r.blocks[0].style.font_size == 16.0
    sheet = paperloom.parse(samples.xlsx("s", [["a", "b"], [1, 2]], ("A1:B1",)))
    table = next(b.table for b in sheet.blocks if b.type == "table")
    assert (table.rows, table.cols, table.cells[1][1].text) == (2, 2, "2")
    failed = paperloom.parse(b"%PDF-1.7")
    assert isinstance(failed, paperloom.ParseFailure) and (failed.file_type, failed.code) == ("pdf", "UNSUPPORTED_FORMAT")
    assert paperloom.parse(b"").code == "EMPTY_INPUT"
    assert [paperloom.detect_format(samples.docx(["x"])), paperloom.detect_zip_format(samples.docx(["x"])), paperloom.detect_ole2_format(samples.hwp(["x"]))] == ["hwpx", "docx", "hwp"]
    assert set(paperloom.__all__) <= set(dir(paperloom))


def test_chosen_pages(spark):
    items = "".join(f'<item id="section{i}" href="Contents/section{i}.xml"/>' for i in range(4))
    refs = "".join(f'<itemref idref="section{i}"/>' for i in range(4))
    more = {"Contents/content.hpf": f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>"} | {f"Contents/section{i}.xml": f"<sec><p><run><t>s{i + 1}</t></run></p></sec>" for i in range(4)}
    docs = spark.createDataFrame([(1, bytearray(samples.hwpx([], more=more)))], "doc_id long, content binary")
    got = {str(p): convert.parse(docs, p).first().markdown for p in ("2-3", [2.5, 4, 9], "8")}
    assert got == {"2-3": "s2\n\ns3", "[2.5, 4, 9]": "s2\n\ns4", "8": "s1\n\ns2\n\ns3\n\ns4"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a [1].docx").write_bytes(samples.docx(["Title", "text"], frozenset([0])))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    assert main([str(tmp_path / "a [1].docx"), "-o", str(tmp_path / "a.md"), "--silent"]) == 0
    assert (tmp_path / "a.md").read_text() == "# Title\n\ntext" and capsys.readouterr().err == ""
    assert main([str(tmp_path / "a [1].docx"), str(tmp_path / "b.pdf"), str(tmp_path / "none"), "-d", str(tmp_path / "out"), "--format", "json", "--no-header-footer"]) == 1
    assert json.loads((tmp_path / "out/a [1].json").read_text()) == {"file_type": "docx", "markdown": "# Title\n\ntext", "page_count": None, "warnings": []}
    err = capsys.readouterr().err
    assert "UNSUPPORTED_FORMAT" in err and "none" in err
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0 and paperloom.VERSION in capsys.readouterr().out


def test_oversized_files_are_error_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "small.docx").write_bytes(samples.docx(["x"]))
    (tmp_path / "large.docx").write_bytes(samples.docx(["y"], more={"word/media/z": bytes(range(256)) * 40}) + bytes(9000))
    monkeypatch.setattr(scan, "MAX_FILE", 5000)
    docs = scan.read_documents(spark, str(tmp_path))
    got = {r.length > 5000: (r.success, r.code) for r in docs.select("doc_id", "length").join(convert.parse(docs), "doc_id").collect()}
    assert got == {False: (True, None), True: (False, "FILE_TOO_LARGE")}


def test_stream_leaves_nothing_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.docx").write_bytes(samples.docx([f"text {name}"]))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    watch.convert_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"text a", "text b"}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept


def test_broken_xml_keeps_what_can_be_read(spark):
    root = parse_xml("<a><b x='1'>one<c>two</b> & three</z><d/>&amp;four")
    assert [n.tag for n in root.walk()] == ["a", "b", "c", "d"] and root.full_text() == "onetwo & three&four"
    hwpx = samples.hwpx(["first"], inner="<hp:p><hp:run><hp:t>second</hp:t></hp:run>")
    docx = samples.docx(["whole"], inner="<w:p><w:r><w:t>torn")
    docs = spark.createDataFrame([(1, bytearray(hwpx)), (2, bytearray(docx))], "doc_id long, content binary")
    assert {r.doc_id: r.markdown for r in convert.parse(docs).collect()} == {1: "first\n\nsecond", 2: "whole\n\ntorn"}
    with pytest.raises(ValueError):
        parse_xml("no markup")


def test_cells_beyond_the_limits_are_told(spark, monkeypatch):
    monkeypatch.setattr(decode, "MAX_ROWS", 2)
    rows = decode.xlsx(samples.xlsx("s", [["a"], ["b"], ["c"], ["d"]]))
    assert [r["attrs"]["code"] for r in rows if r["kind"] == "warning"] == ["TRUNCATED_TABLE"]


def test_nested_table_in_hwpml(spark):
    cell = lambda inner: f'<CELL RowAddr="0" ColAddr="0"><P><TEXT><CHAR>{inner}</CHAR></TEXT></P></CELL>'
    inside = f'<TABLE RowCount="1" ColCount="1"><ROW>{cell("deep")}</ROW></TABLE>'
    outer = f'<TABLE RowCount="1" ColCount="2"><ROW><CELL RowAddr="0" ColAddr="0"><P><TEXT><CHAR>top</CHAR>{inside}</TEXT></P></CELL><CELL RowAddr="0" ColAddr="1"><P><TEXT><CHAR>side</CHAR></TEXT></P></CELL></ROW></TABLE>'
    doc = samples.hwpml([]).replace(b"</SECTION>", outer.encode() + b"</SECTION>")
    found = convert.parse(spark.createDataFrame([(1, bytearray(doc))], "doc_id long, content binary")).first()
    assert found.markdown == "| top<br>[중첩 테이블 #1] | side |\n| --- | --- |"


def test_direct_placement_of_overlapping_cells(spark):
    from paperloom.operators import grid

    cells = [(1, 0, 3, 0, 0, "m", 2, 2), (1, 1, 3, 0, 1, "below", 1, 1), (1, 2, 3, 2, 0, "x", 1, 1), (1, 3, 3, 2, 0, "y", 1, 1), (1, 4, 3, 7, 0, "out", 1, 1), (1, 5, 3, 2, 2, "wide", 5, 1)]
    df = spark.createDataFrame(cells, "t int, i int, n_rows int, r int, c int, text string, col_span int, row_span int")
    got = {(x.r, x.c): (x.text, x.col_span, x.row_span) for x in grid.place_directly(df, ["t"]).collect()}
    assert got == {(0, 0): ("m", 2, 2), (2, 0): ("y", 1, 1), (2, 2): ("wide", 5, 1)}


def test_dominant_value_ties(spark):
    from paperloom.operators import grid

    df = spark.createDataFrame([(1, 0.2, 5), (1, 0.1, 5), (2, 0.3, 1), (2, 0.1, 2), (2, 0.1, 3), (2, 0.3, 4)], "k int, v double, at int")
    assert {(r.k, r.v) for r in grid.dominant_value(df, ["k"], "v", "at").collect()} == {(1, 0.1), (2, 0.1)}
