"""Registered queries of listings, figures, callers, plans and execution logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import security as sec
from quarry.functions import text as tx
from quarry.operators import acl, chunks, graphrag, retrieval, service
from quarry.plans.views import spark_view
from quarry.queries import _BODY_SQL, _HYBRID_SQL, _WORDS, _grade_sql, _light, _mask_sql, _probe, _sees, _texts, query


@query("""SELECT path, owner, allowed_role, allowed_department, effective_date FROM (SELECT * FROM (SELECT CASE WHEN doc_id % 9 = 4 THEN '/assets' || path ELSE path END AS path, owner, allowed_role, allowed_department, effective_date FROM {v_docs} d) e ORDER BY string_split(path, '/') LIMIT 200) f WHERE NOT starts_with(path, '/assets/')""")
def permission_listing(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "v_docs")
    return service.permission_listing(docs.withColumn("path", F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("/assets"), "path")).otherwise(F.col("path"))))


@query("SELECT count(*) AS n_files, sum(strlen(text)) / 1048576.0 AS megabytes FROM documents")
def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return service.storage_totals(spark_view(spark, sf, "documents"))


@query("SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS errors FROM {v_audit} a")
def upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "v_audit")
    return service.upload_summary(rows.select(F.when(F.col("status") != "success", F.col("status")).when(F.col("id") % 2 == 0, "ingested").otherwise("saved").alias("status")))


_BUILT_SQL = "(SELECT path, length(text) % 7 AS ne, length(text) % 5 AS nr, CASE WHEN doc_id % 13 = 0 THEN 'timeout' ELSE '' END AS error FROM {v_docs} d)"


@query(f"""SELECT 'total' AS section, 'processed' AS item, count(*) AS n FROM {_BUILT_SQL} b UNION ALL SELECT 'total', 'entities', CAST(sum(ne) AS BIGINT) FROM {_BUILT_SQL} b
UNION ALL SELECT 'total', 'relationships', CAST(sum(nr) AS BIGINT) FROM {_BUILT_SQL} b UNION ALL SELECT 'error', path || ': ' || error, 1 FROM {_BUILT_SQL} b WHERE error <> ''""")
def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("text")
    docs = spark_view(spark, sf, "v_docs")
    return service.build_stats(docs.select("path", (size % 7).alias("n_entities"), (size % 5).alias("n_relationships"), F.when(F.col("doc_id") % 13 == 0, "timeout").otherwise("").alias("error")))


@query("""SELECT id, user_id FROM {v_audit} a WHERE id % 7 IN (0, 1, 2, 3, 4) AND user_id IN (SELECT 'u' || c_custkey FROM customer WHERE c_custkey % 3 <> 0) AND (id % 11 = 0 OR id % 4 < 3)""")
def admitted_requests(spark: SparkSession, sf: str) -> DataFrame:
    systems = F.array(*map(F.lit, (*service.SYSTEMS, "other", "")))
    requests = spark_view(spark, sf, "v_audit").select("id", "user_id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("http://s"), F.col("id") % 4)).alias("url"), systems[(F.col("id") % 7).cast("int")].alias("system"))
    servers = spark.range(3).select(F.concat(F.lit("http://s"), "id").alias("url"))
    users = spark_view(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("u"), "c_custkey").alias("user_id"))
    return service.admitted(requests, servers, users).select("id", "user_id")


@query("SELECT p_name AS skill, p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 5 = 0) AS installed FROM part")
def installed_flags(spark: SparkSession, sf: str) -> DataFrame:
    offers = spark_view(spark, sf, "part").select(F.col("p_partkey").alias("skill"), "p_name")
    own = spark_view(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select(F.col("l_partkey").alias("skill"))
    return service.with_installed(offers, own).select(F.col("p_name").alias("skill"), F.col("skill").alias("p_partkey"), "installed")


@query("SELECT c_custkey AS user_id, coalesce(n_name, CAST(c_nationkey AS STRING)) AS department_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON n_nationkey = c_nationkey")
def department_names(spark: SparkSession, sf: str) -> DataFrame:
    users = spark_view(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("string").alias("department"))
    names = spark_view(spark, sf, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").cast("string").alias("department"), F.col("n_name").alias("department_name"))
    return service.with_department(users, names).select("user_id", "department_name")


@query("SELECT doc_id, starts_with(path, '/Shared/') AS shared, starts_with(path, '/Private/') AS private, true AS every FROM {v_docs} d")
def workspace_tabs(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return spark_view(spark, sf, "v_docs").select("doc_id", *[service.workspace_of(path, t).alias(n) for t, n in (("Shared", "shared"), ("Private", "private"), ("all", "every"))])


@query("""WITH n AS (SELECT id FROM {v_nodes} x WHERE entity_type = 'nation')
SELECT n.id AS item, m.community AS community FROM n LEFT JOIN (SELECT id, arg_max(community, ord) AS community FROM {v_members} y GROUP BY id) m ON m.id = n.id
UNION ALL SELECT src || '|' || dst, NULL FROM {v_tree_edges} e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def graph_view(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark_view(spark, sf, "v_nodes").where(F.lower("entity_type") == "nation").select("id")
    links = acl.induced_edges(spark_view(spark, sf, "v_tree_edges"), nodes)
    return graphrag.community_tags(nodes, spark_view(spark, sf, "v_members")).select(F.col("id").alias("item"), "community").unionByName(links.select(F.concat_ws("|", "src", "dst").alias("item"), F.lit(None).cast("string").alias("community")))


@query("SELECT id, name FROM (SELECT id, arg_min(name, ord) AS name, min(ord) AS ord FROM {v_entity_events} e GROUP BY id) x ORDER BY ord, id LIMIT 200")
def known_names(spark: SparkSession, sf: str) -> DataFrame:
    return service.known_names(spark_view(spark, sf, "v_entity_events"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '1996-06-01 00:00:00' - INTERVAL 24 HOUR")
def stale_tasks(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    tasks = spark_view(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").alias("completed_at"))
    return service.stale(tasks, F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT l_orderkey AS page, arg_max(l_linenumber, {{'n': CAST(l_quantity AS INT), 'p': -l_linenumber}}) AS table_no, max(CAST(l_quantity AS INT)) AS n_rows FROM lineitem GROUP BY l_orderkey".replace("{{", "{").replace("}}", "}"))
def best_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = spark_view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("table_no"), F.col("l_quantity").cast("int").alias("n_rows"))
    return service.best_tables(found)


@query("SELECT CASE ord % 4 WHEN 0 THEN '보장' WHEN 1 THEN '면책' WHEN 2 THEN '갱신' ELSE 'unlike' END AS label, count(*) AS n FROM {v_edge_events} e GROUP BY 1")
def relation_labels(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*map(F.lit, ("covers", "excludes", "renews_as", "unlike")))
    edges = spark_view(spark, sf, "v_edge_events").select(codes[(F.col("ord") % 4).cast("int")].alias("code"))
    return edges.groupBy(tx.labelled(F.col("code"), service.RELATION_LABELS).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_ITEMS_SQL = "(SELECT l_orderkey AS run, l_linenumber AS pos, 's' || l_linenumber AS skill, 's' || (l_linenumber + 1 + l_orderkey % 2) AS a, CASE WHEN l_orderkey % 11 = 0 THEN 's' || (l_linenumber - 1) ELSE 'none' END AS b FROM lineitem WHERE l_linenumber <= 6)"


@query(f"""WITH RECURSIVE i AS (SELECT * FROM {_ITEMS_SQL} x), d AS (SELECT i.run, i.skill, j.skill AS needs FROM i JOIN i j ON i.run = j.run AND j.skill IN (i.a, i.b)),
r(run, skill, lvl) AS (SELECT run, skill, 0 FROM i UNION SELECT d.run, d.skill, r.lvl + 1 FROM r JOIN d ON d.run = r.run AND d.needs = r.skill WHERE r.lvl < 6),
l AS (SELECT run, skill, max(lvl) AS lvl FROM r GROUP BY run, skill), c AS (SELECT run, max(lvl) >= count(*) AS cyclic FROM l GROUP BY run)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY CASE WHEN cyclic THEN 0 ELSE lvl END, pos) - 1 AS INT) AS step, skill, 'POST' AS method, 'e' || substr(skill, 2) AS endpoint FROM l JOIN c USING (run) JOIN i USING (run, skill)""")
def ordered_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as plans whose lines need later ones, every eleventh both ways; the registry knows six skills."""
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    needs = F.array(name(line + 1 + order % 2), F.when(order % 11 == 0, name(line - 1)).otherwise("none"))
    items = spark_view(spark, sf, "lineitem").select(order.alias("run"), line.alias("pos"), name(line).alias("skill"), needs.alias("depends_on"))
    registry = spark.range(1, 7).select(F.concat(F.lit("s"), "id").alias("skill"), F.lit("POST").alias("method"), F.concat(F.lit("e"), "id").alias("endpoint"))
    return service.ordered_plans(items, registry)


_LOG_SQL = """(SELECT run, step, skill, won IS NOT NULL AS good, coalesce(won, 3) AS attempts, 'in' || step AS input, CASE WHEN won IS NOT NULL THEN 'out ' || won || ' ' || comment END AS output, CASE WHEN won IS NULL THEN 'failed at 3' END AS error
FROM (SELECT o_custkey AS run, o_orderkey AS step, 's' || o_orderkey % 7 AS skill, CASE WHEN o_orderkey % 5 < 3 THEN 1 + o_orderkey % 5 END AS won, repeat('보', CAST(o_orderkey % 250 AS INT)) AS comment FROM orders) w)"""


def _execution(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a step of its customer's run: its number modulo five is the attempt that succeeds, of more than three none."""
    key = F.col("o_orderkey")
    orders = spark_view(spark, sf, "orders").select(F.col("o_custkey").alias("run"), key.alias("step"), (key % 5 + 1).alias("x"), F.concat(F.lit("s"), key % 7).alias("skill"), F.repeat(F.lit("보"), (key % 250).cast("int")).alias("comment"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    tries = orders.where("attempt <= x")
    number = F.col("attempt").cast("string")
    return service.execution_log(tries.select("run", "step", "skill", "attempt", (F.col("attempt") == F.col("x")).alias("ok"), F.concat(F.lit("in"), "step").alias("input"), F.concat_ws(" ", F.lit("out"), number, "comment").alias("output"), F.concat(F.lit("failed at "), number).alias("error")))


@query(f"SELECT run, step, skill, CASE WHEN good THEN 'success' ELSE 'error' END AS status, CAST(attempts AS INT) AS attempts, CAST(power(2, attempts - 1) - 1 AS DOUBLE) AS waited, strlen(input) AS input_bytes, coalesce(strlen(output), 0) AS output_bytes, error FROM {_LOG_SQL} l")
def execution_log(spark: SparkSession, sf: str) -> DataFrame:
    return _execution(spark, sf).drop("output")


@query(f"""SELECT run, sha256(string_agg('[' || CASE WHEN good THEN 'OK' ELSE 'FAIL' END || '] Step ' || step || ': ' || skill || ' (attempts=' || attempts || ', in=' || strlen(input) || 'B, out=' || coalesce(strlen(output), 0) || 'B)' || chr(10) ||
CASE WHEN good THEN '  Output: ' || left(output, 200) ELSE '  Error: ' || error END, chr(10) ORDER BY step)) AS summary, coalesce(string_agg(CASE WHEN NOT good THEN '- 스킬 ''' || skill || ''' (Step ' || step || ') 실패: ' || error END, chr(10) ORDER BY step), '') AS failures FROM {_LOG_SQL} l GROUP BY run""")
def execution_summary(spark: SparkSession, sf: str) -> DataFrame:
    return service.execution_summary(_execution(spark, sf)).withColumn("summary", F.sha2("summary", 256))


@query(f"""WITH h AS (SELECT d.path, d.text, row_number() OVER (ORDER BY h.score DESC, h.doc_id) AS r FROM ({_HYBRID_SQL}) h JOIN {{v_docs}} d ON d.doc_id = h.doc_id)
SELECT '검색 결과:' || chr(10) || chr(10) || string_agg('[' || r || '] ' || path || chr(10) || left(text, 300), chr(10) || chr(10) ORDER BY r) AS answer FROM h WHERE r <= 5""")
def fallback_answer(spark: SparkSession, sf: str) -> DataFrame:
    return service.fallback_answer(retrieval.hybrid_search(_light(spark, sf), _probe(spark, sf), _WORDS, _sees(), texts=_texts(spark, sf)))


@query(f"SELECT doc_id, path, sha256({_mask_sql()}) AS text FROM {{v_pii}} p")
def masked_response(spark: SparkSession, sf: str) -> DataFrame:
    return sec.masked_response(spark_view(spark, sf, "v_pii"), skip=("path",)).withColumn("text", F.sha2("text", 256))


@query(f"SELECT doc_id, owner, security_grade, security_grade = 1 AS learning_allowed, security_grade < 3 AS rag_allowed, n_chars FROM (SELECT doc_id, owner, {_grade_sql()} AS security_grade, length(text) AS n_chars FROM (SELECT m.doc_id, m.path, d.owner, {_BODY_SQL.replace('md,', 'm.md,', 1)} AS text FROM {{v_md}} m JOIN {{v_docs}} d ON d.doc_id = m.doc_id) y) x")
def ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Raw Markdown files to graded bodies with their policy, the owner out of the head."""
    head = F.regexp_extract("md", r"\A---\n(?s:.*?)owner: ([^\n]*)\n(?s:.*?)---\n", 1)
    docs = spark_view(spark, sf, "v_md").select("doc_id", "path", head.alias("owner"), chunks.without_front_matter(F.col("md")).alias("text"))
    graded = docs.withColumn("security_grade", sec.classified(F.col("text"), F.col("path"))["grade"])
    policy = sec.grade_policy(F.col("security_grade"))
    return graded.select("doc_id", "owner", "security_grade", *[policy[k].alias(k) for k in ("learning_allowed", "rag_allowed")], F.length("text").alias("n_chars"))
