"""Compound files and HWPX packages, whole and broken."""

from __future__ import annotations

import random

import pytest

from quarry.queries_packages import compound_file, zipped
from quarry.sources import compound, hwpx, readers

FILES = "path string, content binary"


@pytest.mark.parametrize("deflated", [False, True])
def test_streams_of_all_sizes(deflated):
    rng = random.Random(3)
    sizes = [0, 1, 63, 64, 65, 4095, 4096, 4097, 511, 512, 513, 20_000, 300_000]
    members = {f"i{k}.png": rng.randbytes(n) for k, n in enumerate(sizes)}
    found = {path.removeprefix("BinData/"): (content, error) for path, content, error in compound.images(compound_file(members, deflated))}
    assert found == {name: (content, None) for name, content in members.items()}


def test_list_of_the_allocation_table():
    big = random.Random(4).randbytes(18_000_000)  # more than 109 sectors of table, and a second sector of their list
    assert list(compound.images(compound_file({"a.bmp": big}))) == [("BinData/a.bmp", big, None)]


def _patched(data: bytes, sector: int, value: int) -> bytes:
    """The file with another successor of a sector in the (first sector of the) allocation table."""
    at = (int.from_bytes(data[76:80], "little") + 1) * 512 + sector * 4
    return data[:at] + value.to_bytes(4, "little") + data[at + 4 :]


def test_broken_files_are_rows(spark):
    whole = compound_file({"a.png": b"x" * 5000, "b.png": b"y" * 6000, "note.txt": b"z"})
    torn = _patched(whole, 3, 3)  # a.png runs in a circle
    lost = _patched(whole, 2, 0xFFFFFFF0)
    short = compound_file({"a.png": b"x" * 5000})[:-700]
    package = zipped({"Contents/a.JPG": b"1", "BinData/a.JPG": b"2", "BinData/a_1.JPG": b"3", "x.xml": b"4"})
    files = [("whole", whole), ("torn", torn), ("lost", lost), ("short", short), ("zip", package), ("text", b"hello"), ("empty", b""), ("null", None), ("head", whole[:100]), ("none", compound_file({}))]
    df = spark.createDataFrame(files, FILES)
    rows = {}
    for r in compound.embedded_images(df).collect():
        rows.setdefault(r.path, []).append((r.name, None if r.bytes is None else bytes(r.bytes[:2]), r.error and r.error.split(":")[0]))
    assert rows["whole"] == [("a.png", b"xx", None), ("b.png", b"yy", None)]
    assert rows["torn"] == rows["lost"] == [("a.png", None, "BrokenFile"), ("b.png", b"yy", None)]
    assert rows["zip"] == [("a.JPG", b"2", None), ("a_1.JPG", b"3", None), ("a_2.JPG", b"1", None)]
    assert all(rows[p] == [(None, None, "BrokenFile")] for p in ("short", "text", "empty", "null", "head")) and "none" not in rows
    assert compound.embedded_images(df.where("false")).count() == 0


HEADER = """<hh:head xmlns:hh="h"><hh:fontface lang="HANGUL"><hh:font id="2" face="굴림"/></hh:fontface><hh:charPr id="5" height="2200"><hh:fontRef hangul="2" latin="9"/><hh:bold/><hh:italic/></hh:charPr>
<hh:paraPr id="4"><hh:align horizontal="RIGHT"/><hh:lineSpacing type="FIXED" value="9"/><hh:margin indent="1" left="2" right="3"/></hh:paraPr><hh:style id="1" name="개요 3" engName="Outline 3"/><hh:style id="2" name="바탕글"/></hh:head>"""


def _package(*sections: str, spine: str = "") -> bytes:
    parts = {f"Contents/section{n}.xml": f'<hs:sec xmlns:hs="s" xmlns:hp="p">{s}</hs:sec>' for n, s in enumerate(sections)} | {"Contents/header.xml": HEADER}
    return zipped(parts | ({"Contents/content.hpf": spine} if spine else {}))


def test_properties_are_resolved():
    rows = hwpx.elements(_package('<hp:p paraPrIDRef="4" styleIDRef="1"><hp:run charPrIDRef="5"><hp:t>a<hp:tab/>b<hp:lineBreak/>c</hp:t><hp:t/></hp:run><hp:run charPrIDRef="77"><hp:equation script=" x "/></hp:run></hp:p><hp:p/>'))
    assert [(r["kind"], r["heading"], r["style"], r["align"], r["spacing"], r["spacing_type"], r["indent"], r["left"], r["right"]) for r in rows] == [("paragraph", 3, "개요 3", "RIGHT", 9, "FIXED", 1, 2, 3), ("paragraph", None, None, "LEFT", 150, "PERCENT", 0, 0, 0)]
    unset = {"size": 10.0, "bold": False, "italic": False, "hangul_font": None, "latin_font": None}
    assert rows[0]["runs"] == [{"kind": "text", "text": "a\tb\nc", "size": 22.0, "bold": True, "italic": True, "hangul_font": "굴림", "latin_font": None}, {"kind": "equation", "text": "x"} | unset]
    assert rows[1]["runs"] == []


def test_text_around_tables_and_tables_in_cells():
    cell = '<hp:tc><hp:cellAddr rowAddr="{r}" colAddr="{c}"/><hp:cellSpan rowSpan="1" colSpan="2"/><hp:cellSz width="8" height="9"/><hp:subList>{t}</hp:subList></hp:tc>'
    text = lambda t: f"<hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p>"
    table = lambda *cells: f"<hp:tbl><hp:tr>{''.join(cells)}</hp:tr></hp:tbl>"
    inner = "<hp:p><hp:run>" + table(cell.format(r=0, c=0, t=text("in"))) + "</hp:run></hp:p>"
    outer = table(cell.format(r=0, c=0, t=text("one") + text("two")), cell.format(r=0, c=1, t=inner))
    rows = hwpx.elements(_package(f"<hp:p><hp:run><hp:t>before</hp:t><hp:ctrl>{outer}</hp:ctrl><hp:t>after</hp:t></hp:run></hp:p>{table(cell.format(r=3, c=0, t=text('bare')))}"))
    told = [(r["kind"], r.get("table_id"), r.get("outer_table"), r.get("row"), r.get("col"), "".join(x["text"] for x in r["runs"])) for r in rows]
    assert told == [("paragraph", None, None, None, None, "before"), ("cell", 0, None, 0, 0, "one"), ("cell", 0, None, 0, 0, "two"), ("cell", 1, 0, 0, 0, "in"), ("paragraph", None, None, None, None, "after"), ("cell", 2, None, 3, 0, "bare")]
    assert {(r["col_span"], r["width"], r["height"]) for r in rows if r["kind"] == "cell"} == {(2, 8, 9)}


def test_order_of_sections():
    many = [f"<hp:p><hp:run><hp:t>{n}</hp:t></hp:run></hp:p>" for n in range(12)]
    texts = lambda data: [r["runs"][0]["text"] for r in hwpx.elements(data)]
    assert texts(_package(*many)) == [str(n) for n in range(12)]
    spine = '<package><spine><itemref idref="header"/><itemref idref="section3"/><itemref idref="section1"/><itemref idref="section99"/></spine></package>'
    assert texts(_package(*many, spine=spine)) == ["3", "1"]
    assert [r[-1] for r in readers.hwpx_elements(_package(*many))] == [str(n) for n in range(12)]


def test_page_and_broken_packages(spark):
    page = '<hp:p><hp:run><hp:secPr><hp:pagePr width="10" height="odd"><hp:margin left="1"/></hp:pagePr></hp:secPr></hp:run></hp:p>'
    files = spark.createDataFrame([("ok", _package(page)), ("cut", _package(page)[:50]), ("xml", zipped({"Contents/section0.xml": "<a>"})), ("bare", zipped({"x": ""})), ("null", None)], FILES)
    df = hwpx.styled_elements(files)
    rows = {(r.path, r.kind): r for r in df.collect()}
    assert set(rows) == {("ok", "page"), ("ok", "paragraph"), ("cut", None), ("xml", None), ("null", None)}
    assert rows["ok", "page"].width == 10 and rows["ok", "page"].height == 84200 and rows["ok", "page"].margins["left"] == 1 and rows["ok", "page"].margins["top"] == 2835
    assert rows["cut", None].error == "BadZipFile" and rows["xml", None].error == "ParseError" and rows["ok", "paragraph"].error is None
    assert hwpx.equations(df).count() == 0 and hwpx.styled_elements(files.where("false")).count() == 0


def test_files_leave_python_together(spark):
    """Rows of many small files make few batches."""
    import pyarrow as pa

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run(iter([pa.RecordBatch.from_pylist([{"path": str(i), "content": b"none"} for i in range(300)])])))

    for read in (hwpx.styled_elements, compound.embedded_images):
        made = read(Files())
        assert len(made) == 1 and made[0].num_rows == 300 and made[0].column("error").null_count == 0
