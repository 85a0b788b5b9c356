"""File readers: Markdown with YAML heads, office packages, logs, graph snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunks import gfm
from quarry.sources.hwpx import section_parts

#: Folders that are never documents (fixed values).
HIDDEN_ROOTS = ("Skills", ".graph", ".obsidian", "assets")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content of every .md file outside the hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    below = F.regexp_replace("path", r"^.*?" + _literal(root.rstrip("/")) + "/", "")
    return files.select(below.alias("path"), F.decode("content", "utf-8").alias("content")).where(~F.split("path", "/")[0].isin(*HIDDEN_ROOTS))


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def with_front_matter(files: DataFrame) -> DataFrame:
    """files with meta map<string,string> and body; a head that is no mapping, or broken, gives an empty map."""
    import yaml  # noqa: F401  (fails early on the driver)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import yaml

        for heads in frames:
            out = []
            for h in heads:
                try:
                    made = yaml.safe_load(h) if h else {}
                except yaml.YAMLError:
                    made = {}
                out.append({str(k): str(v) for k, v in made.items() if v is not None} if isinstance(made, dict) else {})
            yield pd.Series(out)

    head = F.regexp_extract("content", r"\A---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace("content", r"\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n)?", "")
    return files.withColumns({"meta": F.pandas_udf(run, "map<string,string>")(head), "body": body})


def policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users: user_id, role, department; globs: role, mode, pattern; departments: department, department_name) of a policy in YAML.

    A policy is configuration, one file that is read on the driver; an empty file is an empty policy, a user without roles has no row.
    """
    import yaml

    raw = spark.read.text(path, wholetext=True).first()
    given = (yaml.safe_load(raw[0]) if raw else None) or {}
    users = [(str(u["user_id"]), str(r), str(u.get("department") or "")) for u in given.get("users") or [] for r in u.get("roles") or []]
    globs = [(str(name), mode, str(p)) for name, rule in (given.get("roles") or {}).items() for mode in ("read", "write") for p in ((rule or {}).get("allowed_paths") or {}).get(mode) or []]
    departments = [(str(d), str(info["name"]) if isinstance(info, dict) and info.get("name") else None) for d, info in (given.get("departments") or {}).items()]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return made(users, "user_id string, role string, department string"), made(globs, "role string, mode string, pattern string"), made(departments, "department string, department_name string")


def audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """Answer records of JSON lines; broken lines are left out."""
    schema = "timestamp string, thread_id string, user_id string, query string, response_preview string, skills_used array<string>, max_security_grade int, access_control struct<grade_2_accessed: boolean, grade_3_accessed: boolean>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def graph_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file; a broken file is an empty graph."""
    schema = "nodes array<struct<id: string, name: string, entity_type: string, mentions: long, source_paths: array<string>>>, links array<struct<source: string, target: string, relation_type: string, weight: double>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.id", F.coalesce("n.name", "n.id").alias("name"), F.coalesce("n.entity_type", F.lit("concept")).alias("entity_type"), F.coalesce("n.mentions", F.lit(0)).alias("mentions"), "n.source_paths")
    edges = raw.select(F.explode("links").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation_type", F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return nodes, edges


def files_by_kind(spark: SparkSession, root: str) -> DataFrame:
    """path, length, kind of every file but hidden and system ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    below = F.regexp_replace("path", r"^.*?" + _literal(root.rstrip("/")) + "/", "")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "md", "markdown").when(ext.isin("docx", "pptx", "xlsx"), "office").when(ext.isin("hwp", "hwpx"), "hwp").when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image").when(ext.isin("txt", "csv", "json"), "text").otherwise("other")
    return files.select(below.alias("path"), "length").where(~F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit(".")) | F.startswith(p, F.lit("__")))).withColumn("kind", kind)


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def workbook_tables(data: bytes) -> list[tuple[str, str]]:
    """(sheet, table as Markdown) of an XLSX package, its first row as the head."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _plain(t.tag) == "t"))
        sheets = [e.attrib["name"] for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _plain(e.tag) == "sheet"]
        out = []
        for n, title in enumerate(sheets, 1):
            rows: list[list[str]] = []
            part = f"xl/worksheets/sheet{n}.xml"
            for row in (e for e in ElementTree.fromstring(z.read(part)).iter() if _plain(e.tag) == "row") if part in names else ():
                cells: dict[int, str] = {}
                for c in row:
                    letters = "".join(x for x in c.attrib.get("r", "") if x.isalpha())
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    value = next((v.text or "" for v in c if _plain(v.tag) == "v"), "")
                    inline = "".join(t.text or "" for t in c.iter() if _plain(t.tag) == "t")
                    cells[at or len(cells) + 1] = shared[int(value)] if c.attrib.get("t") == "s" else inline or value
                rows.append([cells.get(i, "").replace("|", "\\|") for i in range(1, max(cells, default=0) + 1)])
            out.append((title, gfm([r for r in rows if r])))
        return out


def slide_texts(data: bytes) -> list[tuple[int, str, str]]:
    """(number, text, speaker notes) of every slide of a PPTX package, by number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        def lines(part: str) -> str:
            if part not in z.namelist():
                return ""
            paragraphs = (p for p in ElementTree.fromstring(z.read(part)).iter() if _plain(p.tag) == "p")
            return "\n".join(filter(None, ("".join(t.text or "" for t in p.iter() if _plain(t.tag) == "t") for p in paragraphs)))

        numbers = sorted(int(n[16:-4]) for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml") and n[16:-4].isdigit())
        return [(n, lines(f"ppt/slides/slide{n}.xml"), lines(f"ppt/notesSlides/notesSlide{n}.xml")) for n in numbers]


def media_members(data: bytes) -> list[tuple[str, bytes]]:
    """(file name, bytes) of a package's media; a name met again gets a number."""
    seen: dict[str, int] = {}
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for member in sorted(z.namelist()):
            if "/media/" in member or member.startswith("BinData/"):
                name = member.rsplit("/", 1)[-1]
                k = seen.get(name, 0)
                seen[name] = k + 1
                base, dot, ext = name.rpartition(".")
                out.append((name if not k else f"{base or name}_{k}{dot}{ext if base else ''}", z.read(member)))
    return out


def hwpx_elements(data: bytes) -> list[tuple[str, int, int, int, int, str]]:
    """(kind, row, col, row span, col span, text) of the paragraphs and table cells of an HWPX package, in order."""
    out: list[tuple[str, int, int, int, int, str]] = []
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if _plain(t.tag) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in section_parts(z):
            todo = [ElementTree.fromstring(z.read(part))]
            while todo:
                e = todo.pop(0)
                kind = _plain(e.tag)
                if kind == "tbl":
                    for cell in (c for c in e.iter() if _plain(c.tag) == "tc"):
                        at = {k: v for x in cell.iter() if _plain(x.tag) in ("cellAddr", "cellSpan") for k, v in x.attrib.items()}
                        n = lambda k, d: int(at.get(k, d))  # noqa: B023, E731
                        out.append(("cell", n("rowAddr", 0), n("colAddr", 0), n("rowSpan", 1), n("colSpan", 1), text_of(cell)))
                elif kind == "p" and not any(_plain(x.tag) == "tbl" for x in e.iter()):
                    if text := text_of(e):
                        out.append(("paragraph", 0, 0, 1, 1, text))
                else:
                    todo[:0] = list(e)
    return out


_READERS = {
    "xlsx": (workbook_tables, "sheet string, markdown string"),
    "pptx": (slide_texts, "slide int, text string, notes string"),
    "media": (media_members, "member string, bytes binary"),
    "hwpx": (hwpx_elements, "kind string, row int, col int, row_span int, col_span int, text string"),
}


def packages(files: DataFrame, kind: str) -> DataFrame:
    """path, what the reader of the kind finds, error (null unless the file is broken).  files: path, content."""
    reader, schema = _READERS[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, *r, None) for r in reader(bytes(data))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as x:
                    rows = [(path, *[None] * len(names), type(x).__name__)]
                yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")
