"""Registered queries of graph retrieval, contexts, findings and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import security as sec
from quarry.functions import text as tx
from quarry.operators import acl, audit, graphrag, retrieval
from quarry.plans.views import spark_view
from quarry.queries import _HYBRID_SQL, _MATCH_SQL, _WORDS, _light, _probe, _sees, _texts, _who, query
from quarry.sources import sinks
from quarry.streaming import flows

_ASKED = "machinery of Asia and Europe steel"
_READ_SQL = "(CASE WHEN regexp_extract(source_path, '^/+Shared/([^/]+)', 1) IN ('it', 'underwriting') THEN false ELSE starts_with(source_path, '/Public/') OR starts_with(source_path, '/Shared/') OR starts_with(source_path, '/Private/user3/') END)"
_SEEN_SQL = f"(SELECT n.id FROM {{v_nodes}} n WHERE NOT EXISTS (SELECT 1 FROM {{v_node_sources}} s WHERE s.id = n.id) OR EXISTS (SELECT 1 FROM {{v_node_sources}} s WHERE s.id = n.id AND {_READ_SQL}))"
_LOCAL_CTES = f"""WITH RECURSIVE seen AS (SELECT * FROM {_SEEN_SQL} x),
matched AS (SELECT id FROM ({_MATCH_SQL}) m WHERE id IN (SELECT id FROM seen)),
b AS (SELECT src, dst FROM {{v_tree_edges}} e UNION SELECT dst, src FROM {{v_tree_edges}} e),
r(id, hops) AS (SELECT id, 0 FROM matched UNION SELECT b.dst, r.hops + 1 FROM r JOIN b ON b.src = r.id WHERE r.hops < 2),
near AS (SELECT id, min(hops) AS hops FROM r GROUP BY id),
related AS (SELECT id FROM near WHERE hops > 0 AND id IN (SELECT id FROM seen)),
relation AS (SELECT DISTINCT src || '|' || relation_type || '|' || dst AS item, src, dst, relation_type FROM {{v_tree_edges}} e WHERE src IN (SELECT id FROM near WHERE hops < 2) OR dst IN (SELECT id FROM near WHERE hops < 2) ORDER BY src, dst, relation_type LIMIT 20),
source AS (SELECT DISTINCT source_path AS item FROM {{v_node_sources}} s WHERE {_READ_SQL} AND (id IN (SELECT id FROM matched) OR id IN (SELECT id FROM related))),
own AS (SELECT 'matched' AS section, id AS item FROM matched UNION ALL SELECT 'related', id FROM related UNION ALL SELECT 'relation', item FROM relation
  UNION ALL SELECT DISTINCT 'community', community FROM {{v_members}} m WHERE id IN (SELECT id FROM matched))"""
_VECTOR_SQL = f"(SELECT d.path AS item FROM ({_HYBRID_SQL}) h JOIN {{v_docs}} d ON d.doc_id = h.doc_id)"


def _graph(spark: SparkSession, sf: str) -> tuple:
    v = lambda n: spark_view(spark, sf, n)
    return v("v_nodes").select("id", "name", "mentions"), v("v_tree_edges"), v("v_members").select("community", "id"), v("v_node_sources"), _who(spark, sf, "user3").allowed(F.col("source_path"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(_light(spark, sf), _probe(spark, sf), _WORDS, _sees(), texts=_texts(spark, sf))


@query(_LOCAL_CTES + " SELECT section, item FROM own UNION ALL SELECT 'source', item FROM source")
def rag_local(spark: SparkSession, sf: str) -> DataFrame:
    return graphrag.graph_search("local", _ASKED, None, None, *_graph(spark, sf), fuzzy=0)


@query(f"SELECT 'community' AS section, community AS item FROM {{v_communities}} c WHERE summary <> '' OR NOT EXISTS (SELECT 1 FROM {{v_communities}} d WHERE d.summary <> '') UNION ALL SELECT 'vector', item FROM {_VECTOR_SQL} v")
def rag_global(spark: SparkSession, sf: str) -> DataFrame:
    return graphrag.graph_search("global", _ASKED, _near(spark, sf), spark_view(spark, sf, "v_communities"))


@query(_LOCAL_CTES + f", vector AS {_VECTOR_SQL} SELECT section, item FROM own UNION ALL SELECT 'vector', item FROM vector UNION ALL SELECT 'source', item FROM (SELECT item FROM source UNION SELECT item FROM vector) u")
def rag_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return graphrag.graph_search("any", _ASKED, _near(spark, sf), spark_view(spark, sf, "v_communities"), *_graph(spark, sf), fuzzy=0)


@query(f"""WITH h AS (SELECT h.doc_id, h.score, rank() OVER (ORDER BY h.score DESC, h.doc_id) AS r, d.path, d.text FROM ({_HYBRID_SQL}) h JOIN {{v_docs}} d ON d.doc_id = h.doc_id),
p AS (SELECT string_agg('[' || r || '] ' || path || printf(' (score=%.3f)', score) || chr(10) || trim(left(text, 800)) || chr(10), chr(10) ORDER BY r) AS t FROM h),
s AS (SELECT string_agg('- ' || name || ': ' || summary, chr(10) ORDER BY -size, community) AS t FROM {{v_communities}} c WHERE summary <> '')
SELECT '[검색 쿼리: {_ASKED}]' || chr(10) || chr(10) || '=== 검색 결과 (벡터 검색) ===' || chr(10) || p.t || chr(10) || '=== 커뮤니티 요약 ===' || chr(10) || s.t AS context FROM p, s""")
def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    return graphrag.global_context(_ASKED, spark_view(spark, sf, "v_communities"), _near(spark, sf))


@query(f"""SELECT id, '{{"name":"' || name || '","type":"' || entity_type || '","properties":"상품코드=' || id || CASE WHEN mentions % 2 = 0 THEN ', 중증도=' || mentions ELSE '' END || '"}}' AS text
FROM (SELECT * FROM (SELECT id, name, entity_type, mentions FROM {{v_nodes}} n WHERE id IN (SELECT id FROM ({_MATCH_SQL}) m)) x WHERE id IN {_SEEN_SQL} ORDER BY mentions DESC, id LIMIT 5) y""")
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    props = F.create_map(F.lit("product_code"), F.col("id"), F.lit("severity"), F.when(F.col("mentions") % 2 == 0, F.col("mentions").cast("string")).otherwise(""), F.lit("colour"), F.lit("red"))
    *_, sources, may_read = _graph(spark, sf)
    return graphrag.prompt_context(_ASKED, spark_view(spark, sf, "v_nodes").withColumn("properties", props), sources, may_read, fuzzy=0)


@query(f"""WITH seen AS (SELECT * FROM {_SEEN_SQL} x), e AS (SELECT src, dst, relation_type, CASE WHEN src = 'region:3' THEN dst ELSE src END AS other FROM {{v_tree_edges}} t WHERE src = 'region:3' OR dst = 'region:3')
SELECT 'entity' AS section, 'region:3' AS item UNION ALL SELECT DISTINCT 'neighbour', other FROM e WHERE other IN (SELECT id FROM seen) UNION ALL SELECT DISTINCT 'relation', src || '|' || relation_type || '|' || dst FROM e WHERE other IN (SELECT id FROM seen)""")
def entity_detail(spark: SparkSession, sf: str) -> DataFrame:
    entities, edges, _, sources, may_read = _graph(spark, sf)
    return graphrag.entity_detail(entities, edges, sources, may_read, "region:3")


@query("SELECT n.id, m.community FROM {v_nodes} n LEFT JOIN (SELECT id, arg_max(community, ord) AS community FROM {v_members} x GROUP BY id) m ON m.id = n.id")
def community_tag(spark: SparkSession, sf: str) -> DataFrame:
    return graphrag.community_tags(spark_view(spark, sf, "v_nodes").select("id"), spark_view(spark, sf, "v_members"))


@query("""SELECT id, name FROM {v_nodes} n WHERE id LIKE 'nation:%' AND mentions < 15 UNION ALL SELECT id, upper(name) FROM {v_nodes} n WHERE mentions >= 15 AND mentions < 18 AND id LIKE 'nation:%'""")
def subgraph_merge(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark_view(spark, sf, "v_nodes").where("id like 'nation:%'").select("id", "name", "mentions")
    return graphrag.merged_subgraphs([nodes.where("mentions < 15").select("id", "name"), nodes.where("mentions < 18").select("id", F.upper("name").alias("name"))])


def _kinds_sql() -> str:
    one = lambda kind, r: f"SELECT doc_id, '{kind}' AS kind, unnest(range(1, len(f) + 1)) AS i, p, f FROM (SELECT doc_id, string_split_regex(text, '{r}') AS p, regexp_extract_all(text, '{r}') AS f FROM {{v_pii}} d) x"
    parts = " UNION ALL ".join(one(kind, r) for kind, (r, _) in sec.PII.items())
    return f"SELECT doc_id, kind, CAST(list_sum(list_transform(p[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda t: length(t))), 0) AS INT) AS start, CAST(length(f[i]) AS INT) AS length FROM ({parts}) y"


@query(_kinds_sql())
def pii_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "v_pii").select("doc_id", F.explode(sec.pii_findings(F.col("text"))).alias("f"))
    return rows.select("doc_id", "f.kind", "f.start", "f.length")


@query("SELECT count(*) AS n, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') * 100.0 / count(*), 1) AS rate FROM {v_audit} a")
def audit_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return audit.error_rate(spark_view(spark, sf, "v_audit"))


@query("SELECT count(*) FILTER (layer = 'a') AS base, count(*) FILTER (layer = 'b') AS personal, count(*) AS total FROM {v_nodes} n")
def layer_totals(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark_view(spark, sf, "v_nodes")
    return audit.layer_totals(nodes.where("layer = 'a'"), nodes.where("layer = 'b'"))


@query("SELECT coalesce(a.u, b.u) AS user_id, coalesce(a.n, 0) AS n_nodes, coalesce(b.n, 0) AS n_edges FROM (SELECT mentions % 7 AS u, count(*) AS n FROM {v_nodes} n GROUP BY 1) a FULL JOIN (SELECT ord % 9 AS u, count(*) AS n FROM {v_edge_events} e GROUP BY 1) b ON a.u = b.u")
def user_graphs(spark: SparkSession, sf: str) -> DataFrame:
    return audit.user_graphs(spark_view(spark, sf, "v_nodes").select((F.col("mentions") % 7).alias("user_id")), spark_view(spark, sf, "v_edge_events").select((F.col("ord") % 9).alias("user_id")))


@query("SELECT doc_id, left(replace(replace(replace(path, '/', '_'), ':', '_'), ' ', '_'), 100) AS name, path || CASE WHEN doc_id % 3 = 0 THEN ' (p.' || doc_id % 5 || CASE WHEN doc_id % 7 > doc_id % 5 THEN '-' || doc_id % 7 ELSE '' END || ')' ELSE ' [' || effective_date || ']' END AS cited, length(path) + length(text) AS used, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, true AS inside FROM {v_docs} d")
def document_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "v_docs")
    third = F.col("doc_id") % 3 == 0
    cited = tx.citation(F.col("path"), F.when(third, F.col("doc_id") % 5), F.when(third, F.col("doc_id") % 7), F.col("effective_date"), F.lit(None).cast("string"))
    return docs.select("doc_id", tx.safe_name(F.col("path")).alias("name"), cited.alias("cited"), tx.usage(F.col("path"), F.col("text"))["total"].alias("used"), tx.letters(F.col("text"))["latin"].alias("latin"), tx.inside_root(F.substring("path", 2, 1000)).alias("inside"))


@query("SELECT doc_id, 'analyst' AS role FROM {v_docs} d WHERE path LIKE '/Public/src1%' UNION ALL SELECT doc_id, 'admin' FROM {v_docs} d")
def role_globs(spark: SparkSession, sf: str) -> DataFrame:
    globs = spark.createDataFrame([("admin", "read", "/**"), ("analyst", "read", "/Public/src1*/d*.md"), ("viewer", "read", "/Nowhere/*/a.md")], "role string, mode string, pattern string")
    roles = acl.derived_roles(spark_view(spark, sf, "v_docs"), globs)
    return roles.select("doc_id", F.explode(F.split("roles", ",")).alias("role"))


@query("SELECT id, name, entity_type FROM {v_nodes} n")
def graph_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    folder = flows.work_folder(spark, "graph")
    sinks.write_graph(spark_view(spark, sf, "v_nodes").select("id", "name", "entity_type"), spark_view(spark, sf, "v_tree_edges"), folder)
    return sinks.read_graph(spark, folder)[0]


@query("SELECT id, user_id, status FROM {v_audit} a WHERE user_id = 'u7' ORDER BY started_at DESC, id LIMIT 50")
def audit_store(spark: SparkSession, sf: str) -> DataFrame:
    folder = flows.work_folder(spark, "audit")
    rows = spark_view(spark, sf, "v_audit")
    for part in (0, 1):
        sinks.append_audit(rows.where(F.col("id") % 2 == part).withColumn("output_payload", F.struct(F.col("output_payload").alias("text"))), folder)
    return sinks.read_audit(spark, folder, user="u7", limit=50).select("id", "user_id", "status")


@query("WITH a AS (SELECT id, user_id, substr(CAST(started_at AS STRING), 1, 10) AS day FROM {v_audit} a) SELECT id, user_id, day FROM a WHERE day IN (SELECT DISTINCT day FROM a ORDER BY day DESC LIMIT 7)")
def provenance_days(spark: SparkSession, sf: str) -> DataFrame:
    folder = flows.work_folder(spark, "provenance")
    sinks.append_provenance(spark_view(spark, sf, "v_audit").select("id", "user_id", F.date_format("started_at", "yyyy-MM-dd").alias("day")), folder)
    return sinks.read_provenance(spark, folder, "id long, user_id string").select("id", "user_id", "day")


@query("SELECT conv_id AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS memo_id, sha256(text) AS digest FROM conversations")
def memo_store(spark: SparkSession, sf: str) -> DataFrame:
    folder = flows.work_folder(spark, "memos")
    turns = spark_view(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("ord"), "text")
    sinks.append_memos(turns.where("ord < 2"), folder)
    sinks.append_memos(turns.where("ord >= 2"), folder, spark.read.parquet(folder))
    return spark.read.parquet(folder).select("thread_id", "memo_id", F.sha2("text", 256).alias("digest"))
