"""Registered queries of office packages: files are made of the documents, read again and held against SQL over the documents."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.views import spark_view
from quarry.queries import query
from quarry.sources import compound, hwpx


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def compound_file(members: dict[str, bytes], deflated: bool = False) -> bytes:
    """A compound file of 512-byte sectors with a file header and these members in its folder for embedded data."""
    streams = {"FileHeader": b"HWP Document File".ljust(36, b"\0") + bytes([deflated, 0, 0, 0])}
    for name, content in members.items():
        streams[name] = zlib.compress(content, 9, -15) if deflated else content
    blocks, table, small, small_next, places = [], [], b"", [], {}

    def put(data: bytes) -> int:
        start, n = len(blocks), -(-len(data) // 512)
        blocks.extend(data[k * 512 : k * 512 + 512].ljust(512, b"\0") for k in range(n))
        table.extend([*range(start + 1, start + n), compound.END_OF_CHAIN][: n])
        return start if n else compound.END_OF_CHAIN

    for name, content in streams.items():
        if len(content) >= 4096:
            places[name] = put(content)
        else:
            n, places[name] = -(-len(content) // 64), len(small_next)
            small += content.ljust(n * 64, b"\0")
            small_next += [*range(places[name] + 1, places[name] + n), compound.END_OF_CHAIN][:n]

    def entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        spelt = name.encode("utf-16-le")
        return spelt.ljust(64, b"\0") + struct.pack("<HBB3I", len(spelt) + 2, kind, 1, compound.NO_ENTRY, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    none = compound.NO_ENTRY
    directory = entry("Root Entry", compound.ROOT, none, 1, put(small), len(small)) + entry("FileHeader", compound.STREAM, 2, none, places["FileHeader"], 40)
    directory += entry(compound.EMBEDDED, compound.STORAGE, none, 3 if members else none, 0, 0)
    for k, name in enumerate(members):
        directory += entry(name, compound.STREAM, 4 + k if k + 1 < len(members) else none, none, places[name], len(streams[name]))
    at_directory = put(directory.ljust(-(-len(directory) // 512) * 512, b"\0"))
    at_small = put(struct.pack(f"<{len(small_next)}I", *small_next).ljust(-(-len(small_next) // 128) * 512, b"\xff"))
    n_table = n_more = 0
    while n_table * 128 < len(blocks) + n_table + n_more:
        n_table += 1
        n_more = max(0, -(-(n_table - 109) // 127))
    first, first_more = len(blocks), len(blocks) + n_table
    table += [0xFFFFFFFD] * n_table + [0xFFFFFFFC] * n_more + [none] * (n_table * 128 - len(blocks) - n_table - n_more)
    numbers = list(range(first, first + n_table))
    head = compound.COMPOUND + bytes(16) + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6)
    head += struct.pack("<9I", 0, n_table, at_directory, 0, 4096, at_small, -(-len(small_next) // 128), first_more if n_more else compound.END_OF_CHAIN, n_more)
    head += struct.pack("<109I", *(numbers[:109] + [none] * 109)[:109])
    more = b""
    for k in range(n_more):
        listed = numbers[109 + k * 127 : 236 + k * 127]
        more += struct.pack("<128I", *(listed + [none] * 127)[:127], first_more + k + 1 if k + 1 < n_more else compound.END_OF_CHAIN)
    return head + b"".join(blocks) + struct.pack(f"<{len(table)}I", *table) + more


def _packed(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    made = []
    for text, n in zip(texts, numbers):
        content = text.encode()
        name = f"BIN{n}.png"
        kinds = {0: lambda: zipped({"mimetype": "application/hwp+zip", f"BinData/{name}": content}), 1: lambda: compound_file({name: content, "BIN.txt": b"x"}, True), 2: lambda: compound_file({name: content, "b.gif": b"GIF"})}  # noqa: B023
        made.append(kinds[n % 4]() if n % 4 in kinds else b"text:" + content)
    return pd.Series(made)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'BIN' || doc_id || '.png' END AS name, CASE WHEN doc_id % 4 < 3 THEN octet_length(encode(coalesce(text, ''))) END AS n_bytes,
  CASE WHEN doc_id % 4 < 3 THEN sha256(coalesce(text, '')) END AS digest, CASE WHEN doc_id % 4 = 3 THEN 'BrokenFile: neither a package nor a compound file' END AS error FROM documents
UNION ALL SELECT doc_id, 'b.gif', 3, sha256('GIF'), NULL FROM documents WHERE doc_id % 4 = 2""")
def package_images(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as images of packages and compound files, deflated or not, in the mini stream or in sectors; every fourth file is neither."""
    docs = spark_view(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.pandas_udf(_packed, "binary")("text", "doc_id").alias("content"))
    found = compound.embedded_images(files)
    return found.select(F.col("path").cast("long").alias("doc_id"), "name", F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("digest"), "error")


_HEAD = """<head><fontfaces><fontface lang="HANGUL"><font id="0" face="바탕"/></fontface><fontface lang="LATIN"><font id="0" face="Serif"/></fontface></fontfaces>
<charPr id="0" height="1000"/><charPr id="1" height="1600"><fontRef hangul="0" latin="0"/><bold/></charPr><charPr id="2" height="1000"><italic/></charPr>
<paraPr id="0"/><paraPr id="1"><align horizontal="CENTER"/><heading type="OUTLINE" level="1"/><lineSpacing type="PERCENT" value="160"/></paraPr><style id="3" name="본문"/></head>"""
_SECTION = """<sec><p paraPrIDRef="1"><run charPrIDRef="1"><secPr><pagePr width="100"><margin top="7"/></pagePr></secPr><t>{source}</t></run></p>
<p paraPrIDRef="0" styleIDRef="3"><run charPrIDRef="1"><t>{text}</t></run><run charPrIDRef="0"><equation><script>x over {number}</script></equation></run></p>
<p><run><tbl><tr><tc><cellAddr rowAddr="0" colAddr="1"/><cellSpan rowSpan="2" colSpan="1"/><subList><p><run charPrIDRef="2"><t>{lang}</t></run><run><tbl><tr><tc><subList><p><run><t>{number}</t></run></p></subList></tc></tr></tbl></run></p></subList></tc></tr></tbl></run></p></sec>"""
#: Characters that XML cannot hold.
_BARRED = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _written(texts: pd.Series, sources: pd.Series, langs: pd.Series, numbers: pd.Series) -> pd.Series:
    safe = lambda t: escape(t, {"\r": "&#13;"})
    return pd.Series([zipped({"Contents/header.xml": _HEAD, "Contents/section0.xml": _SECTION.format(text=safe(t), source=safe(s), lang=safe(g), number=n)}) for t, s, g, n in zip(texts, sources, langs, numbers)])


def _hwpx_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "documents")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), _BARRED, "")
    content = F.pandas_udf(_written, "binary")(plain("text"), plain("source"), plain("lang"), "doc_id")
    return hwpx.styled_elements(docs.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


_PLAIN_SQL = f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{_BARRED}', '', 'g') AS t, coalesce(source, '') AS s, coalesce(lang, '') AS g FROM documents"
_STYLES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {position} AS position, '{kind}' AS kind, {table} AS table_id, {outer} AS outer_table, {span} AS row_span, {heading} AS heading, {align} AS align, {style} AS style, {text} AS text, {fonts} AS fonts FROM d"
    for position, kind, table, outer, span, heading, align, style, text, fonts in (
        (0, "page", "NULL::INT", "NULL::INT", "NULL::INT", "NULL::INT", "NULL", "NULL", "NULL", "NULL"),
        (1, "paragraph", "NULL", "NULL", "NULL", "2", "'CENTER'", "NULL", "CASE WHEN trim(s) <> '' THEN '## ' ELSE '' END || s", "CASE WHEN s = '' THEN '' ELSE '바탕 Serif 16.0' END"),
        (2, "paragraph", "NULL", "NULL", "NULL", "NULL", "'LEFT'", "'본문'", "CASE WHEN trim(t) = '' THEN t ELSE '**' || t || '**' END || '$x over ' || doc_id || '$'", "CASE WHEN t = '' THEN '' ELSE '바탕 Serif 16.0,' END || '10.0'"),
        (3, "cell", "0", "NULL", "2", "NULL", "'LEFT'", "NULL", "CASE WHEN trim(g) = '' THEN g ELSE '*' || g || '*' END", "CASE WHEN g = '' THEN '' ELSE '10.0' END"),
        (4, "cell", "1", "0", "1", "NULL", "'LEFT'", "NULL", "doc_id::VARCHAR", "'10.0'"),
    )
)


@query(f"WITH d AS ({_PLAIN_SQL}) SELECT * FROM ({_STYLES_SQL}) u WHERE position <> 3 OR text <> ''")
def hwpx_styles(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, emphasis, fonts, sizes, spans and nested tables of packages that hold whole texts."""
    rows = _hwpx_rows(spark, sf)
    fonts = F.array_join(F.transform("runs", lambda r: F.concat_ws(" ", r["hangul_font"], r["latin_font"], r["size"].cast("string"))), ",")
    position = F.col("position") + F.when((F.col("outer_table").isNotNull()) & (F.col("position") == 3), 1).otherwise(0)
    return rows.select(F.col("path").cast("long").alias("doc_id"), position.alias("position"), "kind", "table_id", "outer_table", "row_span", "heading", "align", "style", hwpx.marked(F.col("runs"), F.col("heading")).alias("text"), fonts.alias("fonts"))


@query("""SELECT doc_id, 'x over ' || doc_id AS script, '<m:oMath><m:f><m:num><m:r><m:t>x</m:t></m:r></m:num><m:den><m:r><m:t>' || doc_id || '</m:t></m:r></m:den></m:f></m:oMath>' AS omml FROM documents""")
def hwpx_equations(spark: SparkSession, sf: str) -> DataFrame:
    return hwpx.equations(_hwpx_rows(spark, sf)).select(F.col("path").cast("long").alias("doc_id"), "script", "omml")
