"""Markdown: normalisation, sections, blocks, chunks, passages, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRONT_MATTER = r"\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*\r?\n?"
PAGE = r"^\s*<!--\s*page:(\d+)\s*-->"
#: All before the first line of one to six signs, blanks and a text, then its signs and blanks; lines end at line feeds only, the last of other line ends may follow the text.
FIRST_HEADING = r"\A((?s:.*?))#(?<![^\n]#)(?=#{0,5}[ \t\x0B\f\r]+[^\n\r\x85\u2028\u2029]+[\r\x85\u2028\u2029]?(?:\n|\z))#{0,5}[ \t\x0B\f\r]+"
#: Tags that stay in Markdown (fixed values).
KEPT_TAGS = ("img", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "colgroup", "col", "caption")


def without_front_matter(md: Column) -> Column:
    return F.regexp_replace(md, FRONT_MATTER, "")


def first_heading_up(md: Column) -> Column:
    """The first heading, of whatever level, as a top heading; one pass over the text, however many lines it has."""
    return F.when(F.contains(md, F.lit("#")), F.regexp_replace(md, FIRST_HEADING, "$1# ")).otherwise(md)


def without_tags(md: Column) -> Column:
    """Markdown without HTML tags but those of images and tables."""
    kept = "|".join(KEPT_TAGS)
    return F.regexp_replace(md, rf"(?i)</?(?!(?:{kept})\b)[a-z][a-z0-9]*\s*/?>|</?(?!(?:{kept})\b)[a-z][a-z0-9]*(?:\s+[^>]*)>", "")


def even_tables(md: Column) -> Column:
    """Table lines with one blank around every cell."""

    def line(x: Column) -> Column:
        bare = F.regexp_replace(F.trim(x), r"^\|+|\|+$", "")
        return F.when(F.trim(x).rlike(r"^\|.*\|$"), F.concat(F.lit("| "), F.array_join(F.transform(F.split(bare, r"\|", -1), lambda c: F.trim(c)), " | "), F.lit(" |"))).otherwise(x)

    return F.array_join(F.transform(F.split(md, "\n", -1), line), "\n")


def few_blank_lines(md: Column) -> Column:
    return F.regexp_replace(md, r"\n{3,}", "\n\n")


class _Tables(HTMLParser):
    """Rows of cells of one HTML table, and how many rows its head has."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.head = 0
        self._cell: list[str] | None = None
        self._row: list[str] = []
        self._in_head = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("td", "th"):
            self._cell = []
        elif tag == "tr":
            self._row = []
        elif tag == "thead":
            self._in_head = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._row.append(" ".join("".join(self._cell or []).split()))
            self._cell = None
        elif tag == "tr" and self._row:
            self.rows.append(self._row)
            self.head += self._in_head
        elif tag == "thead":
            self._in_head = False

    def handle_data(self, data: str) -> None:
        if self._cell is not None:
            self._cell.append(data)


def gfm(rows: list[list[str]], head: int = 1) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [r + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in full]
    lines.insert(max(head, 1), "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def html_tables_as_gfm(md: str) -> str:
    def one(m: re.Match) -> str:
        p = _Tables()
        p.feed(m[0])
        table = gfm(p.rows, p.head)
        return f"\n{table}\n" if table else ""

    return re.sub(r"<table[^>]*>.*?</table>", one, md, flags=re.S | re.I)


def layout_tables_as_gfm(text: str) -> str:
    """Three or more lines of columns parted by two blanks or more, mostly of one width, become a table."""
    lines, out, i = text.split("\n"), [], 0
    columns = lambda s: [c.strip() for c in re.split(r" {2,}", s.strip()) if c.strip()]
    while i < len(lines):
        j = i
        rows: list[list[str]] = []
        while j < len(lines) and len(cells := columns(lines[j])) > 1:
            rows.append(cells)
            j += 1
        widths = [len(r) for r in rows]
        if len(rows) >= 3 and max(map(widths.count, widths)) >= 0.6 * len(rows):
            out.append(gfm(rows))
            i = j
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def _per_text(function):
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield texts.map(lambda t: None if t is None else function(t))

    return F.pandas_udf(run, "string")


def tables_from_html(md: Column, tagged: Column | None = None) -> Column:
    """HTML tables as Markdown ones; of texts without any a null goes to Python (a condition alone does not keep them from it).

    tagged: the text with the same tags, where that is cheaper to compute (md itself).
    """
    has = (md if tagged is None else tagged).rlike("(?i)<table")
    return F.when(has, _per_text(html_tables_as_gfm)(F.when(has, md))).otherwise(md)


def tables_from_layout(text: Column) -> Column:
    return _per_text(layout_tables_as_gfm)(text)


def post_processed(md: Column) -> Column:
    """The whole normalisation: heading, tables, tags, table lines, blank lines, one line end."""
    return F.concat(F.regexp_replace(few_blank_lines(even_tables(without_tags(tables_from_html(first_heading_up(md), md)))), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def sections(docs: DataFrame, text: str = "md") -> DataFrame:
    """doc_id, section, heading, start_line, page_start, page_end, content: parts between headings of level 1 to 3."""
    lines = docs.select("doc_id", F.posexplode(F.split(without_front_matter(F.col(text)), "\n", -1)).alias("line", "s"))
    seen = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    page = F.regexp_extract("s", PAGE, 1)
    marked = lines.withColumns({"page": F.when(page != "", page.cast("int")), "head": F.col("s").rlike(r"^#{1,3}\s+").cast("int")})
    placed = marked.withColumns({"section": F.sum("head").over(seen), "so_far": F.last("page", ignorenulls=True).over(seen)})
    part = placed.groupBy("doc_id", "section")
    rows = part.agg(
        F.min("line").alias("start_line"),
        F.min_by("so_far", "line").alias("first_page"),
        F.min("page").alias("own_page"),
        F.max_by("so_far", "line").alias("page_end"),
        F.max(F.when(F.col("head") == 1, F.col("s"))).alias("head_line"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("page").isNull(), F.struct("line", "s")))), lambda x: x["s"]).alias("texts"),
    )
    content = F.regexp_replace(F.array_join("texts", "\n"), r"(?U)^\s+|\s+$", "")
    return rows.select(
        "doc_id", "section", F.coalesce(F.trim(F.regexp_replace("head_line", "^#+", "")), F.lit("")).alias("heading"), "start_line", F.coalesce("first_page", "own_page").alias("page_start"), "page_end", content.alias("content")
    ).where("content <> ''")


def blocks_of(text: Column) -> Column:
    """Tables (lines that start with a bar) and paragraphs, in order."""
    apart = F.regexp_replace(F.regexp_replace(text, r"(?m)(^\|[^\n]*\n)(?!\|)", "$1\n"), r"(?m)(^(?!\|)[^\n]+\n)(?=\|)", "$1\n")
    return F.filter(F.transform(F.split(apart, r"\n(?:[ \t]*\n)+"), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), lambda b: F.trim(b) != "")


def packed(blocks: Column, most: int) -> Column:
    """Blocks joined by blank lines as long as they fit; a block that is too long is cut."""
    cuts = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0)), F.lit(most)), lambda i: F.substr(b, i + 1, F.lit(most)))
    full = lambda s: F.when(s["cur"] != "", F.array_append(s["done"], s["cur"])).otherwise(s["done"])
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))

    def step(s: Column, b: Column) -> Column:
        return (
            F.when(F.length(b) > most, state(F.concat(full(s), cuts(b)), F.lit("")))
            .when((s["cur"] != "") & (F.length(s["cur"]) + 2 + F.length(b) > most), state(full(s), b))
            .otherwise(state(s["done"], F.when(s["cur"] == "", b).otherwise(F.concat_ws("\n\n", s["cur"], b))))
        )

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.filter(F.aggregate(blocks, start, step, full), lambda p: F.trim(p) != "")


def chunks(docs: DataFrame, text: str = "md", most: int = 1000, overlap: int = 100) -> DataFrame:
    """doc_id, idx, chunk_id, heading, start_line, page_start, page_end, content: sections, packed where too long, each with the end of the one before."""
    parts = F.when(F.length("content") > most, packed(blocks_of(F.col("content")), most)).otherwise(F.array("content"))
    rows = sections(docs, text).select("doc_id", "section", "heading", "start_line", "page_start", "page_end", F.posexplode(parts).alias("part", "content"))
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    before = F.lag("content").over(order)
    out = rows.withColumns({"idx": F.row_number().over(order) - 1, "before": before})
    joined = F.when(F.col("before").isNotNull() & F.lit(overlap > 0), F.concat(F.right("before", F.lit(overlap)), F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    return out.select("doc_id", "idx", F.concat_ws("::chunk_", "doc_id", "idx").alias("chunk_id"), "heading", "start_line", "page_start", "page_end", joined.alias("content"))


def passages(text: Column, most: int = 3000) -> Column:
    """Paragraphs joined while their own lengths fit; the start of the text if there is none."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["n"] + F.length(p) <= most) | (F.size(s["cur"]) == 0)
        return F.when(fits, state(s["done"], F.array_append(s["cur"], p), s["n"] + F.length(p))).otherwise(state(F.array_append(s["done"], F.array_join(s["cur"], "\n\n")), F.array(p), F.length(p)))

    none = F.array().cast("array<string>")
    end = lambda s: F.when(F.size(s["cur"]) > 0, F.array_append(s["done"], F.array_join(s["cur"], "\n\n"))).otherwise(s["done"])
    made = F.aggregate(paragraphs, state(none, none, F.lit(0)), step, end)
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.left(text, F.lit(most))))


def filled_grid(cells: DataFrame) -> DataFrame:
    """table_id, row, col, text: merged cells over all places that they cover; the first cell to claim a place keeps it.  cells: table_id, ord, row, col, row_span, col_span, text."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.greatest(F.col("row_span"), F.lit(1)) - 1))
    cols = F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest(F.col("col_span"), F.lit(1)) - 1))
    every = cells.select("table_id", "ord", "text", "col", "col_span", rows.alias("r")).select("table_id", "ord", "text", "r", cols.alias("c"))
    return every.groupBy("table_id", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min_by("text", "ord").alias("text"))


def replaced_chunks(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the chunks of the fresh documents put in place of their old ones."""
    kept = index.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(fresh)
