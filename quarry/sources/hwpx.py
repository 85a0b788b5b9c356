"""HWPX packages: page setup, paragraphs and table cells with their resolved properties."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions.equations import equation

#: Sizes of a page and its margins where the file says nothing, in 1/7200 inch (fixed values).
PAGE = {"width": 59532, "height": 84200}
MARGINS = {"top": 2835, "bottom": 2835, "left": 5386, "right": 5386, "header": 2835, "footer": 2835}
#: What an unset character height, alignment and line spacing mean (fixed values).
HEIGHT, ALIGN, SPACING, SPACING_TYPE = 1000, "LEFT", 150, "PERCENT"
#: Names of styles that are headings, with their level.
HEADING_NAME = re.compile(r"(?:개요|Outline|Heading|제목)\s*([1-9])$")
MAX_LEVEL = 6
#: Characters of rows that leave Python together (one file's at least), and what a row counts besides its texts.
TOGETHER, ROW = 1 << 20, 1 << 9

RUN = "struct<kind: string, text: string, size: double, bold: boolean, italic: boolean, hangul_font: string, latin_font: string>"
SCHEMA = (
    "section int, position int, kind string, table_id int, outer_table int, row int, col int, row_span int, col_span int, width int, height int, "
    f"align string, spacing int, spacing_type string, indent int, left int, right int, style string, heading int, margins map<string, int>, runs array<{RUN}>"
)
NAMES = re.findall(r"(?:^|, )(\w+) (?=int|string|map|array)", SCHEMA)


def _tag(e: Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _children(e: Element, *tags: str) -> Iterator[Element]:
    return (c for c in e if _tag(c) in tags)


def _child(e: Element | None, tag: str) -> Element | None:
    return None if e is None else next(_children(e, tag), None)


def _number(e: Element | None, key: str, default: int) -> int:
    try:
        return int((e.attrib if e is not None else {}).get(key, default))
    except ValueError:
        return default


def _all(root: Element, tag: str) -> dict[int, Element]:
    """Elements of one tag by their id; the first of an id counts."""
    found: dict[int, Element] = {}
    for e in root.iter():
        if _tag(e) == tag:
            found.setdefault(_number(e, "id", -1), e)
    return found


class _Head:
    """Fonts, character and paragraph properties and styles, by their numbers; a number that is not there gives what is unset."""

    def __init__(self, root: Element):
        faces = [(f.attrib.get("lang"), {_number(x, "id", -1): x.attrib.get("face", "") for x in _children(f, "font")}) for f in root.iter() if _tag(f) == "fontface"]
        self.fonts = {lang: fonts for lang, fonts in faces}
        self.characters, self.paragraphs, self.styles = _all(root, "charPr"), _all(root, "paraPr"), _all(root, "style")

    def character(self, n: int) -> dict:
        e = self.characters.get(n)
        ref = _child(e, "fontRef")
        font = lambda lang: self.fonts.get(lang, {}).get(_number(ref, lang.lower(), -1))
        return {"size": _number(e, "height", HEIGHT) / 100, "bold": _child(e, "bold") is not None, "italic": _child(e, "italic") is not None, "hangul_font": font("HANGUL"), "latin_font": font("LATIN")}

    def paragraph(self, e: Element) -> dict:
        style = self.styles.get(_number(e, "styleIDRef", -1))
        of = self.paragraphs.get(_number(e, "paraPrIDRef", 0))
        align, spacing, margin, heading = (_child(of, t) for t in ("align", "lineSpacing", "margin", "heading"))
        name = style.attrib.get("name") if style is not None else None
        level = None
        if heading is not None and heading.attrib.get("type") == "OUTLINE":
            level = _number(heading, "level", 0) + 1
        elif style is not None and (m := next(filter(None, (HEADING_NAME.search(style.attrib.get(k, "")) for k in ("name", "engName"))), None)):
            level = int(m[1])
        return {
            "align": ALIGN if align is None else align.attrib.get("horizontal", ALIGN), "spacing": _number(spacing, "value", SPACING),
            "spacing_type": SPACING_TYPE if spacing is None else spacing.attrib.get("type", SPACING_TYPE), "indent": _number(margin, "indent", 0),
            "left": _number(margin, "left", 0), "right": _number(margin, "right", 0), "style": name, "heading": level,
        }


def _text(t: Element) -> str:
    """A text element's text, with tabs and line breaks inside it."""
    inner = {"tab": "\t", "lineBreak": "\n", "nbSpace": " ", "fwSpace": " "}
    return (t.text or "") + "".join(inner.get(_tag(c), "") + _text(c) + (c.tail or "") for c in t)


def _section_number(part: str) -> int:
    return int(re.search(r"(\d+)\.xml$", part)[1])


def section_parts(z: zipfile.ZipFile) -> list[str]:
    """Names of the section files: in the order of the package's spine, or by number where there is none."""
    names = {n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)}
    spine = []
    if "Contents/content.hpf" in z.namelist():
        refs = (e.attrib.get("idref", "") for e in ElementTree.fromstring(z.read("Contents/content.hpf")).iter() if _tag(e) == "itemref")
        spine = list(dict.fromkeys(f"Contents/{r}.xml" for r in refs if f"Contents/{r}.xml" in names))
    return spine or sorted(names, key=_section_number)


class _Section:
    """One pass over a section; rows come in the order of the text."""

    def __init__(self, head: _Head, number: int, first_table: int):
        self.head, self.number, self.tables, self.rows = head, number, first_table, []

    def put(self, kind: str, **values) -> None:
        self.rows.append({"section": self.number, "position": len(self.rows), "kind": kind} | values)

    def page(self, found: Element) -> None:
        page = _child(found, "pagePr")
        if page is not None:
            margin = next((m for m in page.iter() if _tag(m) == "margin"), None)
            self.put("page", margins={k: _number(margin, k, d) for k, d in MARGINS.items()}, **{k: _number(page, k, d) for k, d in PAGE.items()})

    def paragraph(self, p: Element, place: dict) -> None:
        """The runs before a table, the table, the runs after it; a paragraph without anything is one empty row."""
        kind, props = "cell" if place else "paragraph", self.head.paragraph(p)
        runs, made = [], False
        for run in _children(p, "run"):
            look = self.head.character(_number(run, "charPrIDRef", 0))
            for e in run:
                if _tag(e) == "secPr":
                    self.page(e)
                elif _tag(e) == "t":
                    if text := _text(e):
                        runs.append({"kind": "text", "text": text} | look)
                elif _tag(e) == "equation":
                    script = _child(e, "script")
                    if text := (script.text if script is not None and script.text else "").strip() or e.attrib.get("script", "").strip():
                        runs.append({"kind": "equation", "text": text} | look)
                else:
                    for table in [e] if _tag(e) == "tbl" else _outermost(e, "tbl"):
                        if runs:
                            self.put(kind, runs=runs, **props, **place)
                            runs = []
                        self.table(table, place.get("table_id"))
                        made = True
        if runs or not made:
            self.put(kind, runs=runs, **props, **place)

    def table(self, e: Element, outer: int | None) -> None:
        number = self.tables
        self.tables += 1
        for tr in _children(e, "tr"):
            for tc in _children(tr, "tc"):
                at, span, size = (_child(tc, t) for t in ("cellAddr", "cellSpan", "cellSz"))
                place = {"table_id": number, "outer_table": outer, "row": _number(at, "rowAddr", 0), "col": _number(at, "colAddr", 0), "row_span": _number(span, "rowSpan", 1), "col_span": _number(span, "colSpan", 1)}
                place |= {"width": _number(size, "width", 0), "height": _number(size, "height", 0)}
                for p in _outermost(tc, "p"):
                    self.paragraph(p, place)

    def read(self, root: Element) -> None:
        for e in _outermost(root, "p", "tbl"):
            if _tag(e) == "p":
                self.paragraph(e, {})
            else:
                self.table(e, None)


def _outermost(root: Element, *tags: str) -> Iterator[Element]:
    """Elements of the tags below root, in order, without those inside another."""
    todo = list(root)[::-1]
    while todo:
        e = todo.pop()
        if _tag(e) in tags:
            yield e
        else:
            todo += list(e)[::-1]


def elements(data: bytes) -> list[dict]:
    """Rows of SCHEMA of an HWPX package; tables are numbered through the file.  A package without a head has only unset properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        head = _Head(ElementTree.fromstring(z.read("Contents/header.xml") if "Contents/header.xml" in z.namelist() else "<none/>"))
        rows, tables = [], 0
        for n, part in enumerate(section_parts(z)):
            section = _Section(head, n, tables)
            section.read(ElementTree.fromstring(z.read(part)))
            rows, tables = rows + section.rows, section.tables
        return rows


def styled_elements(files: DataFrame) -> DataFrame:
    """path, the columns of SCHEMA, error (null unless the file is broken, or not there).  files: path, content.

    Kinds are page, paragraph and cell (one row for each paragraph of a table cell).  A table inside a cell has the outer table's
    number in outer_table.  Text before and after a table in one paragraph stays, as rows before and after it.
    """

    kind = StructType.fromDDL(f"path string, {SCHEMA}, error string")
    shape = to_arrow_schema(kind)

    def made(path: str, data: bytes | None) -> list[dict]:
        try:
            return [r | {"path": path, "margins": list(r["margins"].items()) if r.get("margins") else None} for r in elements(data or b"")]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as x:
            return [{"path": path, "error": type(x).__name__}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, data in zip(*batch.columns):  # a file at a time becomes Python objects
                more = made(path.as_py(), data.as_py())
                rows, size = rows + more, size + sum(len(x["text"]) for r in more for x in r.get("runs") or ()) + ROW * len(more)
                if size > TOGETHER:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, kind)


def marked(runs: Column, heading: Column) -> Column:
    """Runs as Markdown: emphasis by their look, equations between dollar signs, a heading's sign in front (and no bold inside)."""
    mark = lambda r: F.when(r["bold"] & heading.isNull() & r["italic"], "***").when(r["bold"] & heading.isNull(), "**").when(r["italic"], "*").otherwise("")
    one = lambda r: F.when(r["kind"] == "equation", F.concat(F.lit("$"), r["text"], F.lit("$"))).when(F.trim(r["text"]) == "", r["text"]).otherwise(F.concat(mark(r), r["text"], mark(r)))
    text = F.array_join(F.transform(runs, one), "")
    return F.concat(F.when(heading.isNotNull() & (F.trim(text) != ""), F.concat(F.repeat(F.lit("#"), F.least(heading, F.lit(MAX_LEVEL))), F.lit(" "))).otherwise(""), text)


def equations(rows: DataFrame) -> DataFrame:
    """path, section, position, script, omml of every equation in rows of styled_elements."""
    found = rows.where("runs is not null").select("path", "section", "position", F.explode(F.filter("runs", lambda r: r["kind"] == "equation")).alias("r"))
    return found.select("path", "section", "position", F.col("r.text").alias("script")).withColumn("omml", equation(F.col("script")))
