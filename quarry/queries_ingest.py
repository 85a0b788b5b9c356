"""Registered queries of ingestion, document trees, streamed calls and contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import contexts, ingestion, trees
from quarry.plans.views import spark_view
from quarry.queries import query
from quarry.queries_fuzzy import _NAME, _TOP_SQL
from quarry.queries_graph import _SEEN_SQL, _graph
from quarry.streaming import calls, flows

_FILES = "SELECT doc_id, concat('/in/f', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.exe' ELSE '.pdf' END) AS path, text AS body FROM {documents}"


def _direct(files: DataFrame) -> DataFrame:
    return files.withColumns({"text": F.when(F.col("path").endswith(".docx"), F.col("body")), "error": F.when(~F.col("path").endswith(".docx"), F.lit("no office package"))})


def _layer(files: DataFrame) -> DataFrame:
    return files.withColumns({"text": F.when(F.col("doc_id") % 3 > 0, F.col("body")).otherwise("12 34"), "error": F.lit(None).cast("string")})


def _recognised(files: DataFrame) -> DataFrame:
    return files.withColumns({"text": F.left("body", F.lit(50)), "error": F.when(F.col("doc_id") % 5 == 0, F.lit("engine stopped"))})


_STEPS = [("direct", _direct, ingestion.not_blank), ("layer", _layer, ingestion.enough_letters), ("recognition", _recognised, ingestion.not_blank)]
_LETTERS_SQL = "length(regexp_replace(body, '[^A-Za-z가-힣]', '', 'g'))"
_CONVERTED_SQL = f"""SELECT doc_id, path, body, CASE WHEN ends_with(path, '.docx') AND regexp_matches(body, '\\S') THEN 'direct' WHEN doc_id % 3 > 0 AND {_LETTERS_SQL} > 100 THEN 'layer'
  WHEN doc_id % 5 > 0 AND regexp_matches(left(body, 50), '\\S') THEN 'recognition' END AS step FROM ({_FILES.replace('{documents}', 'documents')}) f"""


def _converted(spark: SparkSession, sf: str) -> DataFrame:
    return ingestion.converted(spark.sql(_FILES, documents=spark_view(spark, sf, "documents")), _STEPS)


@query(f"SELECT doc_id, step, CASE step WHEN 'direct' THEN 0 WHEN 'layer' THEN 1 WHEN 'recognition' THEN 2 ELSE 3 END AS n_errors, CASE WHEN step = 'recognition' THEN length(left(body, 50)) WHEN step IS NOT NULL THEN length(body) END AS n_chars FROM ({_CONVERTED_SQL}) c")
def converted_files(spark: SparkSession, sf: str) -> DataFrame:
    return _converted(spark, sf).select("doc_id", "step", F.size("errors").alias("n_errors"), F.length("text").alias("n_chars"))


@query(f"SELECT step, count(*) AS n FROM ({_CONVERTED_SQL}) c GROUP BY step")
def conversion_steps(spark: SparkSession, sf: str) -> DataFrame:
    return ingestion.step_counts(_converted(spark, sf))


@query(f"""SELECT CASE WHEN path LIKE '%.exe' THEN 'unsupported format exe' WHEN step IS NULL THEN 'direct: ' || CASE WHEN ends_with(path, '.docx') THEN 'not usable' ELSE 'no office package' END || '; layer: not usable; recognition: ' || CASE WHEN doc_id % 5 = 0 THEN 'engine stopped' ELSE 'not usable' END END AS error, count(*) AS n
FROM ({_CONVERTED_SQL}) c GROUP BY 1""")
def ingest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: conversion, normalisation, grading, writing; how many files ended with which error."""
    files = spark.sql(_FILES, documents=spark_view(spark, sf, "documents"))
    return ingestion.ingest_files(files, _STEPS, "user3", flows.work_folder(spark, "ingest")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


_TREE_SQL = """'{"blocks": [' || CASE WHEN doc_id % 3 = 0 THEN '{"t": "RawBlock", "c": ["markdown", "|' || source || '|"]}' ELSE '{"t": "Image", "c": [["", [], []], [{"t": "Str", "c": "' || CASE WHEN doc_id % 3 = 1 THEN 'about ' || source ELSE 'old' END || '"}], ["img' || doc_id || '.png", ""]]}' END || ', {"t": "Para", "c": [1, null, true]}]}'"""


@query(f"SELECT doc_id, {_TREE_SQL} AS tree FROM documents")
def replaced_images(spark: SparkSession, sf: str) -> DataFrame:
    image = F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".png"))
    tree = F.concat(F.lit('{"blocks": [{"t": "Image", "c": [["", [], []], [{"t": "Str", "c": "old"}], ["'), image, F.lit('", ""]]}, {"t": "Para", "c": [1, null, true]}]}'))
    table = F.col("doc_id") % 3 == 0
    found = F.struct(F.when(table, "table").otherwise("diagram").alias("kind"), F.when(table, F.concat(F.lit("|"), "source", F.lit("|"))).otherwise(F.concat(F.lit("about "), "source")).alias("content"))
    known = F.when(F.col("doc_id") % 3 == 2, F.create_map(F.lit("other.png"), found)).otherwise(F.create_map(image, found))
    return spark_view(spark, sf, "documents").select("doc_id", trees.replaced_images(tree, known).alias("tree"))


_FRAGMENTS = """SELECT concat('c', CAST(conv_id AS STRING)) AS call, CAST(turn % 2 AS INT) AS idx, turn AS ord, CASE WHEN turn < 2 THEN concat('id', CAST(conv_id AS STRING)) ELSE '' END AS id,
  CASE WHEN turn < 2 THEN role END AS name, text AS arguments FROM {conversations}"""


@query(f"""SELECT call, idx, max(id) AS id, coalesce(arg_max(name, struct_pack(o := ord, n := name)) FILTER (name <> ''), '') AS name, sha256(string_agg(coalesce(arguments, ''), '' ORDER BY ord, arguments)) AS digest, count(*) AS n
FROM ({_FRAGMENTS.replace('{conversations}', 'conversations')}) f GROUP BY call, idx""")
def stream_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    fragments = spark.sql(_FRAGMENTS, conversations=flows.table_stream(spark, f"{sf}/conversations.parquet"))
    made = flows.drained(calls.tool_calls(fragments), "update", ["call", "idx"])
    return made.select("call", "idx", "id", "name", F.sha2("arguments", 256).alias("digest"), "n")


_DENIED_SQL = f"""WITH top AS (SELECT t.*, row_number() OVER (ORDER BY score DESC, id) AS nth FROM ({_TOP_SQL(10)}) t),
fine AS (SELECT *, id IN {_SEEN_SQL} AND mentions % 4 < 3 AS fine FROM top),
met AS (SELECT * FROM (SELECT *, coalesce(sum(CAST(fine AS INT)) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fine) x WHERE before < 5)
SELECT CAST(nth AS INT) AS ord, name, entity_type AS type, CAST(mentions % 4 AS INT) AS security_grade FROM met WHERE fine
UNION ALL SELECT 11, '[접근 제한 ' || count(*) || '건]', 'notice', NULL FROM met WHERE NOT fine HAVING count(*) > 0"""


@query(_DENIED_SQL)
def skill_entities(spark: SparkSession, sf: str) -> DataFrame:
    *_, sources, may_read = _graph(spark, sf)
    graded = spark_view(spark, sf, "v_nodes").withColumns({"security_grade": F.col("mentions") % 4, "properties": F.create_map().cast("map<string,string>")})
    return contexts.skill_entities(_NAME, graded, sources, may_read).select("ord", "name", "type", "security_grade")


@query()
def rag_local_context(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, members, sources, may_read = _graph(spark, sf)
    entities = spark_view(spark, sf, "v_nodes").withColumn("properties", F.create_map(F.lit("product_code"), "id"))
    return contexts.search_context("machinery of Asia and Europe steel", entities, edges, members, spark_view(spark, sf, "v_communities"), sources, may_read)
