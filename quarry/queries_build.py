"""Registered queries of graph builds around extraction, plans out of replies and removals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import build
from quarry.plans.views import spark_view
from quarry.queries import query

_FILES_SQL = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/Public/assets' || path WHEN 1 THEN '/Public/README.md' WHEN 2 THEN path || '/.hidden.md' ELSE path END AS path FROM {v_docs} d)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    path, kind = F.col("path"), F.col("doc_id") % 5
    changed = F.when(kind == 0, F.concat(F.lit("/Public/assets"), path)).when(kind == 1, "/Public/README.md").when(kind == 2, F.concat(path, F.lit("/.hidden.md"))).otherwise(path)
    return spark_view(spark, sf, "v_docs").select("doc_id", changed.alias("path"))


@query(f"SELECT doc_id, path FROM {_FILES_SQL} f WHERE NOT regexp_matches(path, '/assets/') AND NOT regexp_matches(path, '/README.md$')")
def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    return build.graph_files(_files(spark, sf))


@query(f"SELECT doc_id, path FROM {_FILES_SQL} f WHERE NOT regexp_matches(path, '/\\.[^/]*$') AND starts_with(path, '/Shared/')")
def build_files(spark: SparkSession, sf: str) -> DataFrame:
    return build.build_files(_files(spark, sf), "/Shared")


_TEXT_SQL = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN repeat('보험', CAST(doc_id % 60 AS INT)) WHEN 1 THEN repeat(' x', CAST(doc_id % 9 AS INT)) ELSE text END AS t FROM documents)"


@query(f"""SELECT doc_id, length(regexp_replace(t, '[^가-힣]', '', 'g')) < 50 AS scanned, length(regexp_replace(t, '[^가-힣A-Za-z]', '', 'g')) > 100 AS usable,
length(CASE WHEN length(trim(t, chr(32) || chr(9) || chr(10) || chr(13))) > 5 THEN trim(t, chr(32) || chr(9) || chr(10) || chr(13)) ELSE '' END) AS n_recognised FROM {_TEXT_SQL} x""")
def conversion_quality(spark: SparkSession, sf: str) -> DataFrame:
    n, kind = F.col("doc_id"), F.col("doc_id") % 4
    text = F.when(kind == 0, F.repeat(F.lit("보험"), (n % 60).cast("int"))).when(kind == 1, F.repeat(F.lit(" x"), (n % 9).cast("int"))).otherwise(F.col("text"))
    found = build.conversion_quality(F.col("t"))
    return spark_view(spark, sf, "documents").select("doc_id", text.alias("t")).select("doc_id", found["scanned"].alias("scanned"), found["usable"].alias("usable"), F.length(found["recognised"]).cast("long").alias("n_recognised"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'table' WHEN doc_id % 3 = 0 THEN 'text' ELSE 'diagram' END AS kind, CASE WHEN doc_id % 2 = 0 THEN '|a|' WHEN doc_id % 3 = 0 THEN source ELSE path END AS content FROM {v_docs} d")
def image_result(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    made = build.image_result(F.when(n % 2 == 0, "|a|"), F.when(n % 3 == 0, F.col("source")).otherwise(""), F.col("path"))
    return spark_view(spark, sf, "v_docs").select("doc_id", made.alias("r")).select("doc_id", "r.kind", "r.content")


_IMAGES_SQL = "(SELECT doc_id, '/assets/' || source || '/d' || doc_id || '.png' AS path, source AS parent, 'd' || doc_id AS stem, doc_id % 3 = 0 AND doc_id % 2 = 0 AS is_table, CASE WHEN doc_id % 4 = 1 THEN '' ELSE text END AS caption FROM {v_docs} d)"


@query(f"""WITH i AS (SELECT *, CASE WHEN is_table THEN 'tbl_' ELSE 'img_' END || stem AS id FROM {_IMAGES_SQL} x), f AS (SELECT i.*, k FROM i, (VALUES ('a key'), ('b')) y(k) WHERE is_table)
SELECT 'node' AS section, id AS item, CASE WHEN is_table THEN '표: ' || parent ELSE left(coalesce(nullif(caption, ''), stem), 80) END AS detail, path AS source_path FROM i
UNION ALL SELECT 'node', 'fact_' || stem || '_' || replace(k, ' ', '_'), k, path FROM f
UNION ALL SELECT 'edge', id, 'contains fact_' || stem || '_' || replace(k, ' ', '_'), path FROM f
UNION ALL SELECT 'edge', id, 'belongs_to ' || parent, path FROM i""")
def asset_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    docs = spark_view(spark, sf, "v_docs").withColumn("path", F.concat(F.lit("/assets/"), "source", F.lit("/d"), n.cast("string"), F.lit(".png")))
    images = docs.select("path", F.when(n % 3 == 0, "table").otherwise("diagram").alias("kind"), F.when(n % 4 == 1, "").otherwise(F.col("text")).alias("caption"), F.when(n % 2 == 0, "|a|").otherwise("").alias("table_md"))
    facts = docs.select("path", F.explode(F.array(F.lit("a key"), F.lit("b"))).alias("key"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("context"))
    nodes, edges = build.asset_graph(images, facts)
    return nodes.select(F.lit("node").alias("section"), F.col("id").alias("item"), F.col("name").alias("detail"), "source_path").unionByName(
        edges.select(F.lit("edge").alias("section"), F.col("src").alias("item"), F.concat_ws(" ", "relation_type", "dst").alias("detail"), "source_path")
    )


@query("""SELECT 'v' || ts AS id, path || '@' || left(commit_hash, 8) AS source_path, effective_date || ' (' || left(commit_hash, 8) || ')' AS label, 'kept' AS own
FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit_hash DESC) AS n FROM {v_versions} v) x WHERE n BETWEEN 2 AND 11""")
def historical_entities(spark: SparkSession, sf: str) -> DataFrame:
    versions = spark_view(spark, sf, "v_versions").select("path", "commit_hash", "ts", F.col("effective_date").alias("day"), F.lit(" note ").alias("message"))
    own = F.create_map(F.lit("version_hash"), F.lit("replaced"), F.lit("own"), F.lit("kept"))
    extracted = versions.select("path", "commit_hash", F.concat(F.lit("v"), "ts").alias("id"), F.lit("x").alias("name"), own.alias("properties"))
    out = build.historical_entities(extracted, versions)
    return out.select("id", "source_path", F.col("properties")["version_label"].alias("label"), F.col("properties")["own"].alias("own"))


@query("""SELECT o_orderkey AS run, CAST(step AS INT) AS step, skill FROM orders JOIN (VALUES (0, 0, 's1'), (0, 1, 's2'), (0, 2, 's3'), (1, 0, 's4'), (1, 1, 's1'), (1, 2, 's2'), (2, 0, 's5'), (2, 1, 's1'), (2, 2, 's2')) p(k, step, skill) ON o_orderkey % 3 = k WHERE o_orderkey % 7 <> 0""")
def plans_from_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies ask for a skill, an unknown one and, twice, the first two of a chain; every seventh is broken."""
    key = F.col("o_orderkey")
    reply = F.format_string('{"skills": [{"name": "s%d", "params": {"a": 1}}, {"name": "s2"}, {"name": "zz"}, {"name": "s1"}, {"name": "s2"}]}', key % 3 + 3)
    replies = spark_view(spark, sf, "orders").select(key.alias("run"), F.when(key % 7 == 0, '{"skills": [').otherwise(reply).alias("reply"))
    number = F.col("id")
    registry = spark.range(1, 7).select(F.concat(F.lit("s"), number).alias("skill"), F.array(F.concat(F.lit("s"), number - 1)).alias("depends_on"), F.lit("POST").alias("method"), F.concat(F.lit("e"), number).alias("endpoint"))
    return build.plans_from_replies(replies, registry).select("run", "step", "skill")


@query("""SELECT 'o' || o_orderkey AS source_path, count(l_orderkey) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 UNION SELECT -1) o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
UNION ALL SELECT 'what is left', count(*) FROM lineitem WHERE l_orderkey % 10 <> 0""")
def removal_counts(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("source_path")
    index = spark_view(spark, sf, "lineitem").select(name("l_orderkey"))
    paths = spark_view(spark, sf, "orders").where("o_orderkey % 10 = 0").select(name("o_orderkey")).unionByName(spark.range(-1, 0).select(name("id")))
    left = build.without_chunks(index, paths).agg(F.count(F.lit(1)).alias("n")).select(F.lit("what is left").alias("source_path"), "n")
    return build.removal_counts(index, paths).withColumnRenamed("n_removed", "n").unionByName(left)


@query("SELECT o_orderkey AS task_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return build.newest_tasks(spark_view(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at")))


@query("SELECT turn AS checkpoint_id, CASE WHEN turn % 2 = 0 THEN 'unknown' ELSE role END AS role, sha256(text) AS content FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def thread_history(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark_view(spark, sf, "conversations")
    first = turns.agg(F.min("conv_id").cast("string").alias("thread")).first()["thread"]  # one value
    message = F.struct(F.when(F.col("turn") % 2 == 1, F.col("role")).alias("role"), F.sha2("text", 256).alias("content"))
    rows = build.thread_history(turns.select(F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("checkpoint_id"), F.array(message).alias("messages")), first)
    return rows.select("checkpoint_id", F.explode("messages").alias("m")).select("checkpoint_id", "m.role", "m.content")
