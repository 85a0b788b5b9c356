"""Registered queries of the engine's own operators and the SQL that says the same.

Every query runs an operator over whole tables; ``oracle_sql`` gives, for each
that SQL can express, a statement over the driver's tables for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import equations, skills
from quarry.functions import security as sec
from quarry.functions import text as tx
from quarry.operators import acl, audit, chunks, community, control, documents, extract, graph, retrieval, workflow
from quarry.plans.views import VIEWS, spark_view, with_views
from quarry.streaming import edge_store, flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if there is one."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_views(sql)
        return f

    return put


def queries() -> dict[str, Query]:
    from quarry import queries_build, queries_fuzzy, queries_graph, queries_ingest, queries_packages, queries_service, queries_stream  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quarry import queries_build, queries_fuzzy, queries_graph, queries_ingest, queries_packages, queries_service, queries_stream  # noqa: F401

    return dict(_SQL)


_USER = ("user3", "viewer", "health_insurance")
_WORDS = "the and of thing"
_PROBE = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _who(spark: SparkSession, sf: str, user: str) -> acl.Principal:
    v = lambda n: spark_view(spark, sf, n)
    return acl.principal(v("v_users"), v("v_role_globs"), v("v_departments"), user)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = spark_view(spark, sf, "v_docs"), spark_view(spark, sf, "embeddings")
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).drop("vec_id", "label")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_docs").select("doc_id", "text")


def _light(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without their texts, which only candidates need."""
    return _chunks(spark, sf).drop("text")


def _probe(spark: SparkSession, sf: str) -> list[float]:
    return list(spark_view(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"])


def _sees() -> Column:
    return acl.Principal(_USER[0], [_USER[1]], _USER[2], {}, []).sees(F.col("owner"), F.col("allowed_role"), F.col("allowed_department"))


_SEES_SQL = "(owner = 'user3' OR allowed_role IN ('viewer') OR (allowed_department = 'health_insurance' AND allowed_department <> ''))"
_DIST_SQL = f"round(1.0 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM {_PROBE} p)), 9)"
_CHUNKS_SQL = "(SELECT d.*, e.embedding FROM {v_docs} d JOIN embeddings e ON e.vec_id = d.doc_id) c"
_NEAR_SQL = "SELECT doc_id, text, path, " + _DIST_SQL + " AS distance FROM " + _CHUNKS_SQL + " WHERE " + _SEES_SQL
_HITS_SQL = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ("and", "of", "the", "thing"))
_HYBRID_SQL = f"""
WITH near AS (SELECT *, {_HITS_SQL} AS hits FROM ({_NEAR_SQL} ORDER BY distance, doc_id LIMIT 30) n)
SELECT doc_id, score FROM (
  SELECT doc_id, round(0.7 * (1.0 - distance / greatest(max(distance) OVER (), 1e-9)) + 0.3 * (hits / greatest(max(hits) OVER (), 1)), 6) AS score FROM near) s
ORDER BY score DESC, doc_id LIMIT 10"""


# -- retrieval ---------------------------------------------------------------


@query(_HYBRID_SQL)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(_light(spark, sf), _probe(spark, sf), _WORDS, _sees(), texts=_texts(spark, sf)).select("doc_id", "score")


@query(f"SELECT doc_id, distance FROM ({_NEAR_SQL}) n ORDER BY distance, doc_id LIMIT 10")
def secure_knn(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.secure_knn(_light(spark, sf), _probe(spark, sf), _sees()).select("doc_id", "distance")


@query(f"SELECT doc_id, distance FROM ({_NEAR_SQL} AND starts_with(path, '/Public/')) n ORDER BY distance, doc_id LIMIT 10")
def path_scoped_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.secure_knn(_light(spark, sf), _probe(spark, sf), _sees() & F.startswith("path", F.lit("/Public/"))).select("doc_id", "distance")


_MATCH_SQL = """SELECT id, name, mentions FROM {v_nodes} n
WHERE contains('machinery of asia and europe steel', lower(name)) OR list_has_any(regexp_extract_all(lower(name), '[a-zA-Z0-9가-힣-]+'), ['machinery', 'of', 'asia', 'and', 'europe', 'steel'])
ORDER BY mentions DESC, id LIMIT 20"""


@query(_MATCH_SQL)
def match_entities(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.matched_entities(spark_view(spark, sf, "v_nodes"), "machinery of Asia and Europe steel", fuzzy=0).select("id", "name", "mentions")


@query("""WITH seeds AS (SELECT id FROM {v_nodes} n WHERE id IN ('nation:3', 'nation:7')),
ids AS (SELECT id FROM seeds UNION SELECT dst FROM {v_tree_edges} e JOIN seeds ON src = id UNION SELECT src FROM {v_tree_edges} e JOIN seeds ON dst = id),
kept AS (SELECT e.* FROM {v_tree_edges} e JOIN ids a ON a.id = e.src JOIN ids b ON b.id = e.dst)
SELECT k.src, k.dst, '- ' || coalesce(a.name, k.src) || ' --[' || relation_type || ']--> ' || coalesce(b.name, k.dst) AS line
FROM kept k LEFT JOIN {v_nodes} a ON a.id = k.src LEFT JOIN {v_nodes} b ON b.id = k.dst ORDER BY k.src, k.dst LIMIT 20""")
def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark_view(spark, sf, "v_nodes")
    edges = spark_view(spark, sf, "v_tree_edges").withColumn("weight", F.lit(1.0))
    return retrieval.local_context(nodes.where(F.col("id").isin("nation:3", "nation:7")), edges, nodes).select("src", "dst", "line")


def _titles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = spark_view(spark, sf, "v_docs")
    vector = docs.where("doc_id % 3 = 0").select(F.col("path").alias("title"), F.col("doc_id").alias("rank"))
    return vector, docs.where("doc_id % 2 = 0").select(F.col("path").alias("title"), F.col("doc_id").alias("rank"))


@query("""WITH g AS (SELECT path AS title, doc_id AS rank, 0 AS from_vector FROM {v_docs} d WHERE doc_id % 2 = 0 ORDER BY rank, title LIMIT 5),
v AS (SELECT path AS title, doc_id AS rank, 1 AS from_vector FROM {v_docs} d WHERE doc_id % 3 = 0 ORDER BY rank, title LIMIT 10),
u AS (SELECT * FROM g UNION ALL SELECT * FROM v WHERE title NOT IN (SELECT title FROM g))
SELECT number, title, from_vector FROM (SELECT row_number() OVER (ORDER BY from_vector, rank, title) AS number, title, from_vector FROM u) x WHERE number <= 10""")
def multi_source(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fused_sources(*_titles(spark, sf), 5)


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY src, dst) AS ord, src, dst, relation_type FROM {v_tree_edges} t),
touch AS (SELECT dst AS id, ord, 0 AS side, relation_type FROM e UNION ALL SELECT src, ord, 1, relation_type FROM e),
first AS (SELECT id, arg_min(relation_type, ord * 2 + side) AS r FROM touch GROUP BY id)
SELECT n.id, coalesce(r, 'related') AS reason FROM {v_nodes} n LEFT JOIN first f ON f.id = n.id""")
def provenance_reason(spark: SparkSession, sf: str) -> DataFrame:
    edges = spark_view(spark, sf, "v_tree_edges").withColumn("ord", F.struct("src", "dst"))
    return retrieval.first_reason(spark_view(spark, sf, "v_nodes").select("id"), edges).select("id", "reason")


@query(f"""SELECT string_agg('[' || printf('%.3f', score) || '] ' || path || chr(10) || left(text, 800), chr(10) || chr(10) ORDER BY -score, doc_id) AS passages
FROM (SELECT h.doc_id, h.score, d.path, d.text FROM ({_HYBRID_SQL}) h JOIN {{v_docs}} d ON d.doc_id = h.doc_id) x""")
def vector_passages(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.hybrid_search(_light(spark, sf), _probe(spark, sf), _WORDS, _sees(), texts=_texts(spark, sf))
    return retrieval.passage_text(found.select("doc_id", F.col("path").alias("heading"), "text", "score"))


@query(f"""SELECT max(score) AS best, CASE WHEN max(score) >= 0.35 THEN 'answer' WHEN (SELECT count(*) FROM ({_MATCH_SQL}) m) = 0 THEN 'refuse' WHEN count(*) > 0 THEN 'rewrite' ELSE 'answer' END AS verdict FROM ({_HYBRID_SQL}) h""")
def retrieval_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.sufficient(hybrid_search(spark, sf), match_entities(spark, sf))


@query("""SELECT source_path, min(rank) AS rank FROM (SELECT id, source_path FROM {v_entity_events} e) s
JOIN (SELECT 'part:' || CAST(k AS STRING) AS id, k AS rank FROM range(1, 21) t(k)) m ON m.id = s.id GROUP BY source_path""")
def related_documents(spark: SparkSession, sf: str) -> DataFrame:
    matched = spark.range(1, 21).select(F.concat(F.lit("part:"), F.col("id").cast("string")).alias("id"), F.col("id").alias("rank"))
    return retrieval.related_documents(matched, spark_view(spark, sf, "v_entity_events"))


# -- access control ----------------------------------------------------------

_READ_SQL = "CASE WHEN regexp_extract(path, '^/+Shared/([^/]+)', 1) IN ('it', 'underwriting') THEN {admin} OR regexp_extract(path, '^/+Shared/([^/]+)', 1) = '{dept}' ELSE {globs} OR starts_with(path, '/Private/{user}/') END"


def _read_sql(user: str, dept: str, globs: list[str], admin: str = "false") -> str:
    tests = " OR ".join([f"starts_with(path, '{g}')" for g in globs] or ["false"])
    return _READ_SQL.format(admin=admin, dept=dept, globs=f"({tests})", user=user)


@query("SELECT doc_id, path FROM {v_docs} d WHERE " + _read_sql("user3", "health_insurance", ["/Public/", "/Shared/"]))
def acl_read_docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_docs").where(_who(spark, sf, "user3").allowed(F.col("path"))).select("doc_id", "path")


@query("SELECT doc_id, path FROM {v_docs} d WHERE " + _read_sql("uw001", "underwriting", ["/Public/underwriting/"]))
def acl_write_docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_docs").where(_who(spark, sf, "uw001").allowed(F.col("path"), "write")).select("doc_id", "path")


@query("SELECT doc_id, CASE WHEN " + _read_sql("user3", "health_insurance", ["/Public/", "/Shared/"]) + " THEN 'ok' WHEN starts_with(path, '/Private/') THEN 'private' ELSE 'no_permission' END AS decision FROM {v_docs} d")
def workspace_decision(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_docs").select("doc_id", _who(spark, sf, "user3").decision(F.col("path")).alias("decision"))


@query(f"SELECT doc_id FROM {{v_docs}} d WHERE {_SEES_SQL}")
def principal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_docs").where(_sees()).select("doc_id")


@query("""WITH s AS (SELECT DISTINCT id, source_path FROM {v_entity_events} e), r AS (SELECT DISTINCT source_path FROM s WHERE source_path < 'order3')
SELECT n.id, coalesce((SELECT string_agg(source_path, ',' ORDER BY source_path) FROM s JOIN r USING (source_path) WHERE s.id = n.id), '') AS readable
FROM {v_nodes} n WHERE n.id NOT IN (SELECT id FROM s) OR n.id IN (SELECT id FROM s JOIN r USING (source_path))""")
def entity_acl(spark: SparkSession, sf: str) -> DataFrame:
    sources = spark_view(spark, sf, "v_entity_events").select("id", "source_path").distinct()
    out = acl.readable_entities(spark_view(spark, sf, "v_nodes").select("id"), sources, sources.where("source_path < 'order3'"))
    return out.select("id", F.array_join("readable_paths", ",").alias("readable"))


@query("SELECT src, dst FROM {v_tree_edges} e WHERE src IN (SELECT id FROM {v_nodes} n WHERE mentions % 2 = 0) AND dst IN (SELECT id FROM {v_nodes} n WHERE mentions % 2 = 0)")
def induced_edges(spark: SparkSession, sf: str) -> DataFrame:
    return acl.induced_edges(spark_view(spark, sf, "v_tree_edges"), spark_view(spark, sf, "v_nodes").where("mentions % 2 = 0")).select("src", "dst")


@query("""SELECT doc_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM {v_docs} d JOIN {v_role_globs} g ON g.mode = 'read' AND starts_with(d.path, rtrim(g.pattern, '*')) GROUP BY doc_id""")
def derived_roles(spark: SparkSession, sf: str) -> DataFrame:
    return acl.derived_roles(spark_view(spark, sf, "v_docs"), spark_view(spark, sf, "v_role_globs"))


_TEMPLATES = "(VALUES ('admin', 'docs.write'), ('admin', 'docs.read'), ('admin', 'users.manage'), ('underwriter', 'docs.read'), ('underwriter', 'uw.assess'), ('viewer', 'docs.read'))"


@query(f"""SELECT u.user_id, coalesce((SELECT 'custom.only' WHERE u.user_id = 'uw001'), (SELECT string_agg(DISTINCT p, ',' ORDER BY p) FROM {_TEMPLATES} t(role, p) WHERE t.role = u.role), '') AS permissions FROM {{v_users}} u""")
def perm_resolution(spark: SparkSession, sf: str) -> DataFrame:
    templates = spark.sql(f"SELECT * FROM {_TEMPLATES} AS t(role, permission)")
    return acl.resolved_permissions(spark_view(spark, sf, "v_users"), templates, spark.sql("SELECT 'uw001' AS user_id, 'custom.only' AS permission"))


@query("SELECT skill, endpoint = '' OR endpoint IN ('core') AS open FROM {v_skills} s")
def skill_role_gate(spark: SparkSession, sf: str) -> DataFrame:
    required = F.when(F.col("endpoint") == "", F.array().cast("array<string>")).otherwise(F.array("endpoint"))
    return spark_view(spark, sf, "v_skills").select("skill", acl.role_gate(required, F.array(F.lit("core"))).alias("open"))


@query("""WITH w AS (SELECT path FROM {v_docs} d WHERE doc_id % 4 = 0 UNION ALL SELECT '/Public/underwriting/none.md')
SELECT path, CASE WHEN NOT (""" + _read_sql("uw001", "underwriting", ["/Public/underwriting/"]) + """) THEN 'denied' WHEN path IN (SELECT path FROM {v_docs} x) THEN 'deleted' ELSE 'not_found' END AS outcome FROM w""")
def bulk_delete(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "v_docs")
    wanted = docs.where("doc_id % 4 = 0").select("path").unionByName(spark.sql("SELECT '/Public/underwriting/none.md' AS path"))
    return acl.delete_outcomes(wanted, docs, _who(spark, sf, "uw001"))


@query("SELECT d.doc_id, d.path FROM {v_docs} d WHERE doc_id % 3 <> 0")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "v_docs")
    done = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("old/"), F.substring_index("path", "/", -1)).alias("source_path"))
    return documents.not_done(docs, done).select("doc_id", "path")


# -- security text -----------------------------------------------------------


def _mask_sql() -> str:
    out = "text"
    for pattern, mask in sec.PII.values():
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return out


@query(f"SELECT doc_id, sha256({_mask_sql()}) AS masked FROM {{v_pii}} p")
def pii_mask_full(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_pii").select("doc_id", F.sha2(sec.mask_full(F.col("text")), 256).alias("masked"))


def _found_sql(shown: str) -> str:
    """The text with shown (of a match m) in place of every match."""
    every = "|".join(f"(?:{p})" for p, _ in sec.PII.values())
    return f"SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(f) THEN f[i] ELSE '' END), '') AS masked FROM (SELECT doc_id, string_split_regex(text, '{every}') AS p, list_transform(regexp_extract_all(text, '{every}'), lambda m: {shown}) AS f FROM {{v_pii}} d) x"


@query(_found_sql("CASE WHEN length(m) <= 4 THEN repeat('*', length(m)) ELSE repeat('*', length(m) - 4) || right(m, 4) END"))
def pii_mask_partial(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_pii").select("doc_id", sec.mask_partial(F.col("text")).alias("masked"))


@query(_found_sql("sha256(m)"))
def pii_mask_hash(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_pii").select("doc_id", sec.mask_hash(F.col("text")).alias("masked"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, (p, _) in sec.PII.items()) + ", length(text) AS scanned FROM {v_pii} p")
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return spark_view(spark, sf, "v_pii").select("doc_id", *[c.alias(k) for k, c in sec.pii_counts(text).items()], F.length(text).alias("scanned"))


@query("SELECT kind, sum(n) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM {{v_pii}} p" for k, (p, _) in sec.PII.items()) + ") x GROUP BY kind HAVING sum(n) > 0")
def pii_report(spark: SparkSession, sf: str) -> DataFrame:
    counted = spark_view(spark, sf, "v_pii").agg(*[F.sum(c).alias(k) for k, c in sec.pii_counts(F.col("text")).items()])
    return counted.unpivot([], list(sec.PII), "kind", "n").where("n > 0")


def _grade_sql() -> str:
    three = " OR ".join(f"regexp_matches(left(text, 5000), '{p}')" for p in sec.GRADE3)
    two = " OR ".join([f"regexp_matches(left(text, 5000), '{p}', 'i')" for p in sec.GRADE2] + [f"contains(lower(path), '{k}')" for k in sec.GRADE2_PATHS])
    return f"CASE WHEN {three} THEN 3 WHEN {two} THEN 2 ELSE 1 END"


@query(f"SELECT doc_id, {_grade_sql()} AS grade, {_grade_sql()} = 1 AS learning_allowed, {_grade_sql()} < 3 AS rag_allowed FROM {{v_pii}} p")
def classify_docs(spark: SparkSession, sf: str) -> DataFrame:
    grade = sec.classified(F.col("text"), F.col("path"))["grade"]
    rows = spark_view(spark, sf, "v_pii").select("doc_id", grade.alias("grade"))
    allowed = sec.grade_policy(F.col("grade"))
    return rows.select("doc_id", "grade", allowed["learning_allowed"].alias("learning_allowed"), allowed["rag_allowed"].alias("rag_allowed"))


@query("SELECT doc_id, security_grade < 3 OR allowed_role = 'admin' AS open FROM {v_docs} d")
def rag_access(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_docs").select("doc_id", sec.rag_access(F.col("security_grade"), F.array("allowed_role")).alias("open"))


def _risk_sql(text: str) -> str:
    parts = []
    for weight, patterns in sec.INJECTION.values():
        hits = " + ".join(f"CAST(regexp_matches({text}, '{p}', 'i') AS INT)" for p in patterns)
        parts.append(f"CASE WHEN ({hits}) > 0 THEN {weight} + least(({hits}) - 1, 3) * {weight * 0.15} ELSE 0.0 END")
    return f"least(round(CASE WHEN length({text}) > 10000 THEN 0.15 ELSE 0.0 END + {' + '.join(parts)}, 4), 1.0)"


@query(f"SELECT doc_id, CAST({_risk_sql('text')} AS DOUBLE) AS risk FROM {{v_pii}} p")
def injection_score(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_pii").select("doc_id", sec.injection_risk(F.col("text")).alias("risk"))


_ANY_SQL = " OR ".join(f"regexp_matches(left(text, 10000), '{p}', 'i')" for _, ps in sec.INJECTION.values() for p in ps)


@query(f"SELECT doc_id, CASE WHEN {_ANY_SQL} THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN NOT ({_ANY_SQL}) THEN length(trim(left(text, 10000), ' ' || chr(10))) END AS clean_length FROM {{v_pii}} p")
def sanitize(spark: SparkSession, sf: str) -> DataFrame:
    made = sec.sanitised(F.col("text"))
    return spark_view(spark, sf, "v_pii").select("doc_id", made["status"].alias("status"), F.length(made["clean"]).alias("clean_length"))


@query(f"SELECT doc_id, CAST({_risk_sql('text')} AS DOUBLE) >= 0.7 AS blocked, concat_ws(',', CASE WHEN contains(text, 'stupid') THEN 'stupid' END, CASE WHEN contains(text, 'worthless') THEN 'worthless' END) AS topics FROM {{v_pii}} p")
def guardrail_test(spark: SparkSession, sf: str) -> DataFrame:
    topics = F.filter(F.array(F.lit("stupid"), F.lit("worthless")), lambda t: F.contains("text", t))
    return spark_view(spark, sf, "v_pii").select("doc_id", (sec.injection_risk(F.col("text")) >= sec.THRESHOLD).alias("blocked"), F.array_join(topics, ",").alias("topics"))


# -- text tables -------------------------------------------------------------

_BODY_SQL = r"regexp_replace(md, '\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*\r?\n?', '')"


@query(f"SELECT doc_id, sha256({_BODY_SQL}) AS body FROM {{v_md}} m")
def strip_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_md").select("doc_id", F.sha2(chunks.without_front_matter(F.col("md")), 256).alias("body"))


_LINES_SQL = f"SELECT doc_id, generate_subscripts(string_split({_BODY_SQL}, chr(10)), 1) - 1 AS line, unnest(string_split({_BODY_SQL}, chr(10))) AS s FROM {{v_md}} m"
_SECTIONS_SQL = f"""
WITH lines AS ({_LINES_SQL}),
marked AS (SELECT *, try_cast(nullif(regexp_extract(s, '^\\s*<!--\\s*page:(\\d+)\\s*-->', 1), '') AS INT) AS page, CAST(regexp_matches(s, '^#{{1,3}}\\s+') AS INT) AS head FROM lines),
placed AS (SELECT *, sum(head) OVER w AS section, last_value(page IGNORE NULLS) OVER w AS so_far FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
parts AS (SELECT doc_id, section, min(line) AS start_line, arg_min(coalesce(so_far, -1), line) AS first_page, min(page) AS own_page, max(so_far) AS page_end, max(CASE WHEN head = 1 THEN s END) AS head_line,
  trim(string_agg(CASE WHEN page IS NULL THEN s END, chr(10) ORDER BY line), ' ' || chr(10)) AS content FROM placed GROUP BY doc_id, section)
SELECT doc_id, section, coalesce(trim(regexp_replace(head_line, '^#+', '')), '') AS heading, start_line, coalesce(nullif(first_page, -1), own_page) AS page_start, page_end, content FROM parts WHERE content <> ''"""


@query(f"SELECT doc_id, CAST(section AS BIGINT) AS section, heading, CAST(start_line AS INT) AS start_line, page_start, page_end, sha256(content) AS content FROM ({_SECTIONS_SQL.replace('{{', '{').replace('}}', '}')}) x".replace("#{1,3}", "#{{1,3}}").replace("{{1,3}}", "{1,3}"))
def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.sections(spark_view(spark, sf, "v_md")).withColumn("content", F.sha2("content", 256))


@query()
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunks(spark_view(spark, sf, "v_md"))


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_BODY_SQL}, '\n{{{{2,}}}}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM {{v_md}} m),
r(doc_id, i, idx, n) AS (SELECT doc_id, 1, 0, length(p[1]) FROM d UNION ALL SELECT r.doc_id, r.i + 1, CASE WHEN r.n + length(p[r.i + 1]) <= 3000 THEN idx ELSE idx + 1 END, CASE WHEN r.n + length(p[r.i + 1]) <= 3000 THEN r.n + length(p[r.i + 1]) ELSE length(p[r.i + 1]) END FROM r JOIN d ON d.doc_id = r.doc_id WHERE r.i < len(p))
SELECT r.doc_id, r.idx, string_agg(d.p[r.i], chr(10) || chr(10) ORDER BY r.i) AS passage FROM r JOIN d ON d.doc_id = r.doc_id GROUP BY r.doc_id, r.idx""".replace("{{2,}}", "{2,}"))
def passages(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_md").select("doc_id", F.posexplode(chunks.passages(chunks.without_front_matter(F.col("md")))).alias("idx", "passage"))


@query("SELECT doc_id, sha256(regexp_replace(md, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')) AS md FROM {v_md} m".replace("{{3,}}", "{3,}"))
def collapse_blank(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_md").select("doc_id", F.sha2(chunks.few_blank_lines(F.col("md")), 256).alias("md"))


_KEPT_SQL = "|".join(chunks.KEPT_TAGS)
_TAGLESS_SQL = f"replace(regexp_replace(regexp_replace(%s, '(?i)<(/?(?:{_KEPT_SQL}))\\b', chr(1) || '\\1', 'g'), '(?i)</?[a-z][a-z0-9]*\\s*/?>|</?[a-z][a-z0-9]*(?:\\s+[^>]*)>', '', 'g'), chr(1), '<')"
_LINED_SQL = "regexp_replace(regexp_replace(%s, '(?m)^\\|([^|\n]*)\\|([^|\n]*)\\|$', '| \\1 | \\2 |', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_POST_SQL = "regexp_replace(" + _LINED_SQL % (_TAGLESS_SQL % "regexp_replace(md, '(?m)^#{1,6}[ \t]+', '# ')") + ", '^\\s+|\\s+$', '', 'g') || chr(10)"


@query(f"SELECT doc_id, {_POST_SQL} AS md FROM {{v_md}} m")
def post_process(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_md").select("doc_id", chunks.post_processed(F.col("md")).alias("md"))


@query("SELECT page_id, " + _TAGLESS_SQL % "html" + " AS text FROM pages")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "pages").select("page_id", chunks.without_tags(F.col("html")).alias("text"))


@query("SELECT o_orderkey, chr(10) || '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |' || chr(10) AS md FROM orders")
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("<table><tr><th>key</th><th>status</th></tr><tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderstatus"), F.lit("</td></tr></table>")).alias("html"))
    return rows.select("o_orderkey", chunks.tables_from_html(F.col("html")).alias("md"))


@query("""WITH l AS (SELECT n_regionkey, '| ' || n_name || ' | ' || n_nationkey || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name || '  ' || n_nationkey) AS i FROM nation)
SELECT n_regionkey, string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY i) AS md FROM l GROUP BY n_regionkey""")
def layout_tables(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("  ", F.col("n_name"), F.col("n_nationkey").cast("string"))
    text = spark_view(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return text.select("n_regionkey", chunks.tables_from_layout(F.col("text")).alias("md"))


@query("""SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey""")
def gfm_render(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("r")))).alias("x"))
    table = F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), F.transform("x", lambda y: y["r"]))
    return rows.select("n_regionkey", tx.gfm_table(table).alias("md"))


_CELLS = "SELECT n_regionkey AS table_id, n_nationkey AS ord, CAST(n_nationkey % 3 AS INT) AS \"row\", CAST(n_nationkey % 4 AS INT) AS col, CAST(1 + n_nationkey % 2 AS INT) AS row_span, CAST(1 + n_nationkey % 3 AS INT) AS col_span, n_name AS text FROM nation"


@query(f"""SELECT table_id, r AS "row", c AS col, arg_min(text, ord) AS text FROM (SELECT *, unnest(range(col, col + col_span)) AS c FROM (SELECT *, unnest(range("row", "row" + row_span)) AS r FROM ({_CELLS}) x) y) z GROUP BY ALL""")
def grid_fill(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark_view(spark, sf, "nation").selectExpr("n_regionkey AS table_id", "n_nationkey AS ord", "n_nationkey % 3 AS row", "n_nationkey % 4 AS col", "1 + n_nationkey % 2 AS row_span", "1 + n_nationkey % 3 AS col_span", "n_name AS text")
    return chunks.filled_grid(cells)


@query(r"SELECT doc_id, unnest(regexp_extract_all(md, '\[\[([^\]]+)\]\]', 1)) AS target FROM {v_md} m")
def wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_md").select("doc_id", F.explode(tx.wikilinks(F.col("md"))).alias("target"))


@query(r"""WITH links AS (SELECT doc_id, 'd' || doc_id AS src, unnest(regexp_extract_all(md, '\[\[([^\]]+)\]\]', 1)) AS dst FROM {v_md} m) SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM links GROUP BY src, dst""")
def wikilink_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.link_graph(spark_view(spark, sf, "v_md")).select("src", "dst", "weight")


@query(r"""SELECT doc_id, list_min(p) AS first_page, list_max(p) AS last_page FROM (SELECT doc_id, list_transform(regexp_extract_all(md, '<!--\s*page:(\d+)\s*-->', 1), lambda x: CAST(x AS INT)) AS p FROM {v_md} m) x""")
def page_range(spark: SparkSession, sf: str) -> DataFrame:
    pages = tx.page_numbers(F.col("md"))
    return spark_view(spark, sf, "v_md").select("doc_id", F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"))


_ARTICLES = "concat('제', CAST(1 + doc_id % 5 AS STRING), '조 및 제 ', CAST(3 + doc_id % 7 AS STRING), ' 조')"


@query(f"SELECT doc_id, CASE WHEN least(1 + doc_id % 5, 3 + doc_id % 7) = greatest(1 + doc_id % 5, 3 + doc_id % 7) THEN '제' || (1 + doc_id % 5) || '조' ELSE '제' || least(1 + doc_id % 5, 3 + doc_id % 7) || '조~제' || greatest(1 + doc_id % 5, 3 + doc_id % 7) || '조' END AS label FROM documents")
def section_ref(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "documents").select("doc_id", tx.section_label(F.expr(_ARTICLES)).alias("label"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2025-04-01' WHEN 2 THEN '2023-07-09' WHEN 3 THEN '2025-04-01' ELSE '2022-11-30' END AS d FROM documents""")
def effective_date(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "documents").withColumn("k", F.col("doc_id") % 5)
    meta = F.when(F.col("k") == 0, "2024-05-01").otherwise("")
    body = F.concat(F.when(F.col("k") == 1, "[68364_D02_20250401] ").when(F.col("k") == 2, "시행일: 2023.7.9 ").otherwise(""), F.regexp_replace("text", "[0-9]", ""))
    name = F.when(F.col("k") == 3, "x_2504.md").when(F.col("k") == 4, "report20221130.md").otherwise("plain.md")
    return docs.select("doc_id", tx.effective_date(meta, body, name).alias("d"))


@query("""SELECT id, trim(regexp_replace(lower(trim(name)), '[^a-z0-9_]+', '_', 'g'), '_') AS slug, entity_type = 'region' AS is_region FROM {v_nodes} n""")
def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_nodes").select("id", tx.slug(F.col("name")).alias("slug"), (F.col("entity_type") == "region").alias("is_region"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9가-힣]+'))) AS n FROM documents")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 'n' || o_orderkey END AS name FROM orders""")
def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit('{"name": "n'), F.col("o_orderkey").cast("string"), F.lit('"}'))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Here it is: "), made, F.lit(" done"))).otherwise("no braces here")
    return spark_view(spark, sf, "orders").select("o_orderkey", tx.salvaged_json(raw, "name string")["name"].alias("name"))


# -- graph -------------------------------------------------------------------


def _in_file_order(spark: SparkSession, sf: str, view: str) -> DataFrame:
    """Events of the line items; of events with one ord the first in the file comes first."""
    rows = spark_view(spark, sf, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    events = spark.sql(VIEWS[view].replace(" AS ord,", " AS ord, at,"), lineitem=rows)
    return events.withColumn("ord", F.struct("ord", "at")).drop("at")


@query("""WITH e AS (SELECT * FROM {v_entity_events} x),
paths AS (SELECT id, string_agg(source_path, ',' ORDER BY ord) AS paths FROM (SELECT id, source_path, min(ord) AS ord FROM e GROUP BY id, source_path) p GROUP BY id),
props AS (SELECT id, string_agg(prop_key || '=' || v, ',' ORDER BY prop_key) AS props FROM (SELECT id, prop_key, arg_min(prop_value, ord) AS v FROM e GROUP BY id, prop_key) p GROUP BY id)
SELECT e.id, arg_min(name, ord) AS name, count(*) AS mentions, any_value(paths) AS paths, any_value(props) AS props FROM e JOIN paths USING (id) JOIN props USING (id) GROUP BY e.id""")
def entity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.upsert_entities(_in_file_order(spark, sf, "v_entity_events"))
    props = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.select("id", "name", "mentions", F.array_join("source_paths", ",").alias("paths"), props.alias("props"))


@query("SELECT src, dst, arg_min(relation_type, ord) AS relation_type, arg_min(source_path, ord) AS source_path, CAST(count(*) AS DOUBLE) AS weight FROM {v_edge_events} e GROUP BY src, dst")
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.upsert_edges(_in_file_order(spark, sf, "v_edge_events"))
    return out.withColumn("weight", F.col("weight").cast("double"))


_LINE_EDGES = """SELECT concat('order', CAST(l_orderkey % 97 AS STRING)) AS src, concat('supplier', CAST(l_suppkey AS STRING)) AS dst, l_returnflag AS relation_type, 'lineitem' AS source_path,
  ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, CAST(l_quantity AS DOUBLE) AS weight, l_linestatus AS mode, CAST(l_linenumber AS STRING) AS line FROM lineitem"""


def _line_edges(spark: SparkSession, rows: DataFrame) -> DataFrame:
    raw = spark.sql(_LINE_EDGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=rows)
    return raw.select("src", "dst", "relation_type", "source_path", "ord", "weight", F.create_map(F.lit("mode"), "mode", F.lit("line"), "line").alias("properties"))


_PROPERTY_SQL = f"SELECT src, dst, arg_min(relation_type, ord) AS relation_type, arg_min(weight, ord) + count(*) - 1 AS weight, arg_min(mode, ord) AS mode, arg_min(line, ord) AS line FROM ({_LINE_EDGES}) e GROUP BY src, dst"


def _with_properties(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "relation_type", "weight", F.col("properties")["mode"].alias("mode"), F.col("properties")["line"].alias("line"))


@query(_PROPERTY_SQL)
def edge_properties(spark: SparkSession, sf: str) -> DataFrame:
    return _with_properties(graph.upsert_edges(_line_edges(spark, spark_view(spark, sf, "lineitem"))))


@query(_PROPERTY_SQL)
def stream_edge_properties(spark: SparkSession, sf: str) -> DataFrame:
    raw = _line_edges(spark, flows.table_stream(spark, f"{sf}/lineitem.parquet"))
    return _with_properties(edge_store.incremental_edges(raw, flows.work_folder(spark, "edges")))


@query("""WITH RECURSIVE b AS (SELECT src, dst FROM {v_tree_edges} e UNION ALL SELECT dst, src FROM {v_tree_edges} e),
r(id, hops) AS (SELECT 'nation:3', 0 UNION SELECT b.dst, r.hops + 1 FROM r JOIN b ON b.src = r.id WHERE r.hops < 2), near AS (SELECT id, min(hops) AS hops FROM r GROUP BY id)
SELECT e.src, e.dst, e.relation_type, CAST(min(n.hops) + 1 AS INT) AS hop FROM {v_tree_edges} e JOIN near n ON n.id = e.src OR n.id = e.dst WHERE n.hops < 2 GROUP BY 1, 2, 3""")
def traversed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.traversed(spark_view(spark, sf, "v_tree_edges"), "nation:3", 2)[1]


@query("SELECT src, dst, relation_type, CAST(count(*) AS DOUBLE) AS weight FROM {v_edge_events} e GROUP BY src, dst, relation_type")
def edge_upsert_multi(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.upsert_edges(spark_view(spark, sf, "v_edge_events"), by_relation=True)
    return out.select("src", "dst", "relation_type", F.col("weight").cast("double").alias("weight"))


@query("SELECT id, id AS name, 'concept' AS entity_type FROM (SELECT src AS id FROM {v_edge_events} e UNION SELECT dst FROM {v_edge_events} e) x WHERE id NOT IN (SELECT id FROM {v_nodes} n WHERE mentions % 2 = 0)")
def stub_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stub_nodes(spark_view(spark, sf, "v_edge_events"), spark_view(spark, sf, "v_nodes").where("mentions % 2 = 0")).select("id", "name", "entity_type")


@query("""SELECT 'entity' AS kind, entity_type AS label, count(*) AS n FROM {v_nodes} n GROUP BY 2 UNION ALL SELECT 'relation', relation_type, count(*) FROM {v_tree_edges} e GROUP BY 2
UNION ALL SELECT 'nodes', '', count(*) FROM {v_nodes} n UNION ALL SELECT 'edges', '', count(*) FROM {v_tree_edges} e""")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(spark_view(spark, sf, "v_nodes"), spark_view(spark, sf, "v_tree_edges"))


@query("""SELECT id, CASE WHEN mentions % 3 = 0 THEN name || ' (own)' ELSE name END AS name, CASE WHEN mentions % 3 = 0 THEN mentions + 100 ELSE mentions END AS mentions FROM {v_nodes} n""")
def layer_merge(spark: SparkSession, sf: str) -> DataFrame:
    base = spark_view(spark, sf, "v_nodes").select("id", "name", "mentions")
    own = base.where("mentions % 3 = 0").select("id", F.concat("name", F.lit(" (own)")).alias("name"), (F.col("mentions") + 100).alias("mentions"))
    return graph.merged_layers(base, own)


@query("SELECT layer, count(*) AS n FROM {v_nodes} n GROUP BY layer")
def layer_stats(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_nodes").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


_BOTH_SQL = "(SELECT src, dst FROM {v_tree_edges} e UNION SELECT dst, src FROM {v_tree_edges} e)"


def _hops_sql(depth: int) -> str:
    return f"""WITH RECURSIVE b AS (SELECT * FROM {_BOTH_SQL} x), r(id, hops) AS (SELECT 'nation:3', 0 UNION SELECT b.dst, r.hops + 1 FROM r JOIN b ON b.src = r.id WHERE r.hops < {depth})
SELECT id, min(hops) AS hops FROM r GROUP BY id HAVING min(hops) > 0"""


@query(_hops_sql(1))
def neighbors_k1(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(spark_view(spark, sf, "v_tree_edges"), "nation:3", 1)


@query(_hops_sql(2))
def neighbors_k2(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(spark_view(spark, sf, "v_tree_edges"), "nation:3", 2)


@query(_hops_sql(3))
def neighbors_k3(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(spark_view(spark, sf, "v_tree_edges"), "nation:3", 3)


@query("""WITH s AS (SELECT 'nation:3' AS id UNION SELECT dst FROM {v_tree_edges} e WHERE src = 'nation:3' UNION SELECT src FROM {v_tree_edges} e WHERE dst = 'nation:3')
SELECT src, dst FROM {v_tree_edges} e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subgraph(spark_view(spark, sf, "v_tree_edges"), spark.sql("SELECT 'nation:3' AS id")).select("src", "dst")


@query("SELECT id, count(*) AS n FROM {v_entity_events} e WHERE source_path = 'order7.md' GROUP BY id")
def entity_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_entity_events").where("source_path = 'order7.md'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, name AS label, entity_type AS type, mentions AS size FROM {v_nodes} n")
def viz_export(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_nodes").select("id", F.col("name").alias("label"), F.col("entity_type").alias("type"), F.col("mentions").alias("size"))


@query("""SELECT name, doc_id FROM (SELECT source AS name, doc_id, row_number() OVER (PARTITION BY source ORDER BY effective_date DESC, doc_id) AS r FROM {v_docs} d WHERE effective_date <= '2024-06-15') x WHERE r = 1""")
def version_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "v_docs").select(F.col("source").alias("name"), "doc_id", "effective_date", F.col("doc_id").alias("rank"))
    return graph.newest_versions(rows, "2024-06-15").select("name", "doc_id")


@query("""WITH RECURSIVE b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {v_tree_edges} e UNION ALL SELECT dst, src FROM {v_tree_edges} e) x), r(id, root) AS (SELECT src, src FROM b WHERE src LIKE 'region:%' UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.id)
SELECT c.id, min(o.id) AS component FROM (SELECT id, min(root) AS root FROM r GROUP BY id) c JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) o USING (root) GROUP BY c.id""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(spark_view(spark, sf, "v_tree_edges"))


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "v_tree_edges").select("src", "dst", F.lit(1.0).alias("weight"))


@query()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    edges = _weighted(spark, sf)
    members = community.louvain_communities(edges)
    return graph.community_table(members, spark_view(spark, sf, "v_nodes")).withColumn("entity_ids", F.array_join("entity_ids", ","))


@query()
def label_communities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.label_communities(_weighted(spark, sf))


@query("SELECT 'e' || (doc_id % 20) AS id, string_agg(CASE WHEN doc_id % 10 < 3 THEN path ELSE 'Shared/' || source || '/d' || doc_id || '.md' END, ',' ORDER BY doc_id) AS paths FROM {v_docs} d GROUP BY 1")
def fix_paths(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "v_docs")
    entities = docs.groupBy(F.concat(F.lit("e"), (F.col("doc_id") % 20).cast("string")).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "path"))), lambda x: x["path"]).alias("source_paths"))
    return graph.repaired_paths(entities, docs.where("doc_id % 10 < 3")).select("id", F.array_join("source_paths", ",").alias("paths"))


# -- audit -------------------------------------------------------------------


@query("SELECT id, user_id, skill_name FROM {v_audit} a WHERE status = 'success' AND skill_name = 'skill_2' AND started_at >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 20")
def audit_query(spark: SparkSession, sf: str) -> DataFrame:
    return audit.page_of(spark_view(spark, sf, "v_audit"), 50, 20, status="success", skill_name="skill_2", start="2024-01-03 00:00:00").select("id", "user_id", "skill_name")


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status NOT IN ('success', 'error')) AS other, round(count(*) FILTER (status = 'success') / count(*), 4) AS success_rate FROM {v_audit} a""")
def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    return audit.status_counts(spark_view(spark, sf, "v_audit"))


@query("""SELECT skill_name, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, round(avg(duration_s) FILTER (status = 'success'), 3) AS avg_duration_s, round(count(*) FILTER (status = 'success') / count(*), 4) AS success_rate
FROM {v_audit} a WHERE skill_name IS NOT NULL GROUP BY skill_name""")
def skill_usage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.skill_usage(spark_view(spark, sf, "v_audit"))


@query("""WITH r AS (SELECT user_id, coalesce(skill_name, 'direct') AS skill, substr(CAST(started_at AS STRING), 1, 10) AS day FROM {v_audit} a ORDER BY started_at DESC, id DESC LIMIT 500)
SELECT 'user' AS kind, user_id AS label, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'skill', skill, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'day', day, count(*) FROM r GROUP BY 2""")
def usage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return audit.usage(spark_view(spark, sf, "v_audit"))


@query("""SELECT count(*) AS total, count(*) FILTER (lower(status) LIKE '%denied%' OR output_payload LIKE '%403%') AS violations, count(*) FILTER (lower(reasoning) LIKE '%injection%' OR lower(output_payload) LIKE '%injection%') AS injections, count(*) FILTER (status = 'error') AS errors, count(DISTINCT user_id) AS users FROM {v_audit} a""")
def governance(spark: SparkSession, sf: str) -> DataFrame:
    return audit.governance(spark_view(spark, sf, "v_audit"))


@query("SELECT substr(CAST(started_at AS STRING), 1, 10) AS day, count(*) AS n FROM {v_audit} a GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def recent_days(spark: SparkSession, sf: str) -> DataFrame:
    return audit.newest_days(spark_view(spark, sf, "v_audit"))


@query("SELECT doc_id AS id, left(source, 500) AS query, left(text, 200) AS response_preview, greatest(1 + doc_id % 3, 1 + doc_id % 2) AS max_security_grade, 1 + doc_id % 3 = 2 OR 1 + doc_id % 2 = 2 AS grade_2_accessed, 1 + doc_id % 3 = 3 AS grade_3_accessed FROM documents")
def provenance_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("query"), F.col("text").alias("response"), F.expr("array(CAST(1 + doc_id % 3 AS INT), CAST(1 + doc_id % 2 AS INT))").alias("grades"))
    return audit.provenance(rows)


@query("""SELECT server, load, CASE WHEN load < 40 THEN 'green' WHEN load < 75 THEN 'yellow' ELSE 'red' END AS signal FROM (SELECT CAST(user_id % 9 AS BIGINT) AS server, CAST(floor(count(*) FILTER (event_id % (2 + user_id % 9) <> 0) * 100 / count(*)) AS INT) AS load FROM events GROUP BY 1) x""")
def load_signal(spark: SparkSession, sf: str) -> DataFrame:
    return audit.load_signal(spark_view(spark, sf, "events").selectExpr("user_id % 9 AS server", "event_id % (2 + user_id % 9) AS state"))


@query("""SELECT 'requests_total' AS name, CAST(event_id AS DOUBLE) AS value FROM events UNION ALL SELECT 'latency_seconds', value FROM events""")
def prom_parse(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("# HELP requests_total n\nrequests_total{a=\"b\"} "), F.col("event_id").cast("string"), F.lit("\n\nlatency_seconds "), F.col("value").cast("string"))
    return audit.metric_lines(spark_view(spark, sf, "events").select(body.alias("body")))


@query("SELECT security_grade AS grade, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM {v_docs} d GROUP BY 1")
def grade_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return audit.grade_shares(spark_view(spark, sf, "v_docs"))


# -- skills, memory, rules ---------------------------------------------------

_LEVEL_SQL = """WITH RECURSIVE d AS (SELECT skill, dep FROM {v_skill_deps} x WHERE dep IN (SELECT skill FROM {v_skills} s)),
r(skill, level) AS (SELECT skill, 0 FROM {v_skills} s UNION SELECT d.skill, r.level + 1 FROM r JOIN d ON d.dep = r.skill)
SELECT skill, CAST(max(level) AS INT) AS level FROM r GROUP BY skill"""


@query(_LEVEL_SQL)
def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.levels(spark_view(spark, sf, "v_skills"), spark_view(spark, sf, "v_skill_deps"))


@query(f"""WITH RECURSIVE c(skill) AS (SELECT 'skill1' UNION SELECT dep FROM c JOIN {{v_skill_deps}} x ON x.skill = c.skill), l AS ({_LEVEL_SQL})
SELECT CAST(row_number() OVER (ORDER BY level, skill) AS INT) AS step, skill FROM l WHERE skill IN (SELECT skill FROM c)""")
def exec_plan(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.execution_plan(spark_view(spark, sf, "v_skills"), spark_view(spark, sf, "v_skill_deps"), "skill1")


@query("SELECT skill, 'missing endpoint' AS problem FROM {v_skills} s WHERE endpoint = '' UNION ALL SELECT skill, 'unknown dependency ' || dep FROM {v_skill_deps} x WHERE dep NOT IN (SELECT skill FROM {v_skills} s)")
def skill_validation(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.violations(spark_view(spark, sf, "v_skills"), spark_view(spark, sf, "v_skill_deps"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x WHERE r <= 3")
def recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.recent_turns(spark_view(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) x WHERE n > 6 AND r > 3")
def to_summarize(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.to_summarise(spark_view(spark, sf, "conversations")).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'thing')")
def memo_recall(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.recalled(spark_view(spark, sf, "conversations"), "Thing").select("conv_id", "turn")


@query("""SELECT conv_id, string_agg(array_to_string(string_split(text, chr(10))[1:3], chr(10)), chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x WHERE r <= 5 GROUP BY conv_id""")
def memory_context(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.memory_context(spark_view(spark, sf, "conversations"))


_DISEASE = "CASE WHEN {s} = 'chronic' AND {v} = 'severe' THEN 'decline' WHEN {s} = 'chronic' AND {v} = 'moderate' AND {d} = 'standard' THEN 'substandard' WHEN {s} = 'active' THEN 'refer' ELSE {d} END"


@query("WITH a AS (SELECT *, total_existing + requested AS total_after, " + _DISEASE.format(s="status1", v="severity1", d="'standard'") + " AS d1 FROM {v_uw} u), b AS (SELECT *, " + _DISEASE.format(s="status2", v="severity2", d="d1") + """ AS d2 FROM a),
c AS (SELECT *, CASE WHEN occupation_grade >= 4 AND d2 = 'standard' THEN 'substandard' ELSE d2 END AS d3 FROM b)
SELECT customer_id, CASE WHEN total_after > 500000000 AND d3 IN ('standard', 'substandard') THEN 'refer' ELSE d3 END AS decision, total_after,
CAST(status1 IN ('chronic', 'active') AS INT) + CAST(status2 IN ('chronic', 'active') AS INT) + CAST(occupation_grade >= 3 AS INT) + CAST(age >= 55 AS INT) AS n_risks,
CAST(status1 = 'active' OR (status1 = 'chronic' AND severity1 IN ('severe', 'moderate')) AS INT) + CAST(status2 = 'active' OR (status2 = 'chronic' AND severity2 IN ('severe', 'moderate')) AS INT)
+ CAST(occupation_grade >= 4 AS INT) + CAST(age >= 65 AS INT) + CAST(total_after > 300000000 AS INT) + CAST(active_policies >= 5 AS INT) AS n_warnings FROM c""")
def underwriting(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda n: F.struct(F.col(f"status{n}").alias("status"), F.col(f"severity{n}").alias("severity"))
    return workflow.underwritten(spark_view(spark, sf, "v_uw").withColumn("diseases", F.array(one(1), one(2)))).drop("label")


# -- documents and sinks -----------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'chunk new' ELSE 'chunk old' END AS content FROM documents")
def chunk_replace(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "documents").select("doc_id")
    return chunks.replaced_chunks(docs.withColumn("content", F.lit("chunk old")), docs.where("doc_id % 3 = 0").withColumn("content", F.lit("chunk new")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'default' END AS a, 'extra' AS b, '2024-01-01' AS created_at FROM documents")
def meta_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    existing = F.when(F.col("doc_id") % 2 == 0, m(a="own", b="own")).otherwise(F.create_map().cast("map<string,string>"))
    made = documents.merged_metadata(m(a="default", updated_at="2024-01-01"), existing, m(b="extra"))
    rows = spark_view(spark, sf, "documents").select("doc_id", made.alias("m"))
    return rows.select("doc_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["created_at"].alias("created_at"))


@query("SELECT path, max(commit_hash) AS commit_hash, max(ts) AS ts FROM {v_versions} v WHERE ts <= 400 GROUP BY path")
def doc_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return documents.as_of(spark_view(spark, sf, "v_versions"), 400)


@query("SELECT path, commit_hash, CAST(n AS INT) AS n FROM (SELECT path, commit_hash, row_number() OVER (PARTITION BY path ORDER BY ts DESC) AS n FROM {v_versions} v) x WHERE n BETWEEN 2 AND 11")
def doc_history(spark: SparkSession, sf: str) -> DataFrame:
    return documents.history(spark_view(spark, sf, "v_versions")).select("path", "commit_hash", "n")


@query("SELECT path, CASE WHEN path = (SELECT path FROM {v_versions} v WHERE commit_hash = '00000007') THEN 'rollback' ELSE max(commit_hash) END AS commit_hash FROM {v_versions} w GROUP BY path")
def rollback(spark: SparkSession, sf: str) -> DataFrame:
    versions = spark_view(spark, sf, "v_versions")
    path = versions.where("commit_hash = '00000007'").first()["path"]
    return documents.current(documents.rolled_back(versions, path, "00000007", 10**12)).select("path", "commit_hash")


@query(f"SELECT doc_id, length(new) AS n FROM (SELECT doc_id, md, {_POST_SQL} AS new FROM {{v_md}} m) x WHERE trim(new) <> trim(md)")
def reprocess_diff(spark: SparkSession, sf: str) -> DataFrame:
    return documents.reprocessed(spark_view(spark, sf, "v_md"), chunks.post_processed(F.col("md"))).select("doc_id", F.length("md").alias("n"))


@query("""WITH p AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM {v_docs} d), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS d FROM p)
SELECT DISTINCT '/' || array_to_string(p[1:d], '/') AS path, d = len(p) AS is_file, CAST(d AS INT) AS depth FROM e""")
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return documents.tree_nodes(spark_view(spark, sf, "v_docs"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'auditor' ELSE allowed_role END AS allowed_role FROM {v_docs} d")
def permission_update(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark_view(spark, sf, "v_docs")
    return documents.updated_permissions(docs, docs.where("doc_id % 10 = 1").select("path", F.lit("auditor").alias("allowed_role"))).select("doc_id", "allowed_role")


@query("SELECT count(*) FILTER (n > 0) AS indexed, coalesce(sum(n) FILTER (n > 0), 0) AS chunks, count(*) FILTER (n < 0) AS errors, count(*) FILTER (n = 0) AS skipped FROM (SELECT doc_id % 7 - 1 AS n FROM documents) x")
def reindex_summary(spark: SparkSession, sf: str) -> DataFrame:
    return documents.reindex_summary(spark_view(spark, sf, "documents").selectExpr("text AS path", "doc_id % 7 - 1 AS n"))


# -- streaming ---------------------------------------------------------------


@query("SELECT substr(CAST(ts AS STRING), 1, 10) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    return flows.drained(flows.daily_counts(flows.table_stream(spark, f"{sf}/events.parquet")))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return flows.drained(flows.rate_breaches(flows.table_stream(spark, f"{sf}/events.parquet"), 1))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return flows.drained(flows.first_seen(flows.table_stream(spark, f"{sf}/events.parquet"), ["event_id"]).select("event_id"), "append")


@query("SELECT conv_id, count(*) AS n_turns, CASE WHEN count(*) > 6 THEN 3 ELSE count(*) END AS n_kept, CASE WHEN count(*) > 6 THEN count(*) - 3 ELSE 0 END AS n_folded FROM conversations GROUP BY conv_id")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return flows.drained(flows.compacted_sessions(flows.table_stream(spark, f"{sf}/conversations.parquet")), "update", ["conv_id"])


@query("SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2")
def stream_incremental_graph(spark: SparkSession, sf: str) -> DataFrame:
    raw = flows.table_stream(spark, f"{sf}/lineitem.parquet").selectExpr("concat('s', l_suppkey) AS src", "concat('p', l_partkey) AS dst", "l_returnflag AS relation_type", "l_orderkey * 10 + l_linenumber AS ord", "'lineitem' AS source_path", "1.0D AS weight")
    store = flows.work_folder(spark, "edges")
    return edge_store.incremental_edges(raw, store).select("src", "dst", F.col("weight").cast("double").alias("weight"))


# -- extraction, skills, control ---------------------------------------------


@query("SELECT doc_id, t AS name FROM (SELECT doc_id, text, unnest(['stupid', 'worthless', 'disgusting', 'License']) AS t FROM documents) x WHERE contains(lower(text), lower(t))")
def extracted_entities(spark: SparkSession, sf: str) -> DataFrame:
    docs = extract.dictionary_answers(spark_view(spark, sf, "v_docs"), {"stupid": "term", "worthless": "term", "disgusting": "term", "License": "condition"})
    return extract.raw_entities(docs).select(F.floor(F.col("ord") / 1000).alias("doc_id"), "name")


@query("""WITH f AS (SELECT doc_id, list_filter(['License', 'disgusting', 'stupid', 'worthless'], lambda t: contains(lower(text), lower(t))) AS l FROM documents)
SELECT lower(l[k]) AS src, lower(l[k + 1]) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT l, unnest(range(1, len(l))) AS k FROM f) x GROUP BY 1, 2""")
def extracted_edges(spark: SparkSession, sf: str) -> DataFrame:
    docs = extract.dictionary_answers(spark_view(spark, sf, "v_docs"), dict.fromkeys(("stupid", "worthless", "disgusting", "License"), "condition"))
    return graph.upsert_edges(extract.raw_edges(docs, extract.raw_entities(docs))).select("src", "dst", F.col("weight").cast("double").alias("weight"))


@query("SELECT n_regionkey AS table_id, n_name AS subject, 'key' AS key, CAST(n_nationkey AS STRING) AS value FROM nation")
def table_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.collect_list(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("r"))
    return extract.table_facts(rows.select("table_id", F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), "r").alias("rows")))


@query("SELECT doc_id, 'img' || doc_id || '.png' AS src, 'a b' AS alt FROM documents")
def document_images(spark: SparkSession, sf: str) -> DataFrame:
    tree = F.concat(F.lit('{"blocks": [{"t": "Para", "c": [{"t": "Image", "c": [["", [], []], [{"t": "Str", "c": "a"}, {"t": "Space"}, {"t": "Str", "c": "b"}], ["img'), F.col("doc_id").cast("string"), F.lit('.png", ""]]}]}]}'))
    return spark_view(spark, sf, "documents").select("doc_id", F.explode(extract.document_images(tree)).alias("i")).select("doc_id", "i.src", "i.alt")


@query()
def equation_omml(spark: SparkSession, sf: str) -> DataFrame:
    script = F.concat(F.lit("SUM from {i=1} to {"), F.col("n_nationkey").cast("string"), F.lit("} x_i^2 over sqrt{alpha}"))
    return spark_view(spark, sf, "nation").select("n_nationkey", equations.equation(script).alias("omml"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'module: os' WHEN 1 THEN 'call: eval' ELSE '' END AS problems FROM documents")
def code_validate(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "import os\ndef run(): return 1").when(F.col("doc_id") % 3 == 1, "def run(x): return eval(x)").otherwise("import math\ndef run(x): return math.sqrt(x)")
    return spark_view(spark, sf, "documents").select("doc_id", F.array_join(skills.validated(source), ",").alias("problems"))


@query("SELECT doc_id, 'skill' || doc_id AS skill, 'custom' AS category FROM documents")
def code_header(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("# skill: skill"), F.col("doc_id").cast("string"), F.lit("\n# category: custom\nx = 1\n# late: no\n"))
    rows = spark_view(spark, sf, "documents").select("doc_id", skills.header(source).alias("h"))
    return rows.select("doc_id", F.col("h")["skill"].alias("skill"), F.col("h")["category"].alias("category"))


@query("SELECT doc_id, length(text) > 100 OR length(text) - length(replace(text, '?', '')) > 1 OR contains(lower(text), 'think') AS hard FROM documents")
def query_router(spark: SparkSession, sf: str) -> DataFrame:
    return spark_view(spark, sf, "documents").select("doc_id", control.hard_question(F.col("text")).alias("hard"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS success, CASE o_orderkey % 4 WHEN 1 THEN 'E001' WHEN 2 THEN 'E777' END AS error_code FROM orders")
def legacy_response(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, '{"header": {"resultCode": "0000"}}').when(k == 1, '{"header": {"resultCode": "E001"}}').when(k == 2, '{"header": {"resultCode": "E777"}}').otherwise("not json")
    made = control.response_result(F.lit(200), body)
    return spark_view(spark, sf, "orders").select("o_orderkey", made["success"].alias("success"), made["error_code"].alias("error_code"))


@query("SELECT skill, CASE WHEN skill IN ('skill3', 'skill6') THEN 'custom' ELSE endpoint END AS endpoint FROM {v_skills} s")
def registry_layers(spark: SparkSession, sf: str) -> DataFrame:
    base = spark_view(spark, sf, "v_skills").select("skill", "endpoint")
    return control.layered([base, base.where("skill in ('skill3', 'skill6')").withColumn("endpoint", F.lit("custom"))], "skill")


@query("SELECT path, count(DISTINCT effective_date) > 1 AS many FROM {v_versions} v GROUP BY path")
def many_versions(spark: SparkSession, sf: str) -> DataFrame:
    return control.many_versions(spark_view(spark, sf, "v_versions").select("path", F.col("effective_date").alias("label")))


@query("SELECT conv_id AS call, sha256(string_agg(text, '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def continued_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark_view(spark, sf, "conversations").select(F.col("conv_id").alias("call"), F.col("turn").alias("ord"), F.col("text").alias("piece"))
    return control.continued_text(parts).withColumn("text", F.sha2("text", 256))


@query("SELECT n_nationkey AS idx, n_name AS name, 1000 AS memory_total FROM nation")
def device_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(", ", F.col("n_nationkey").cast("string"), "n_name", F.lit("1000"), F.lit("10"), F.lit("990"), F.lit("5"), F.lit("40"))
    return control.device_lines(spark_view(spark, sf, "nation").select(line.alias("line"))).select("idx", "name", "memory_total")


@query("""WITH k AS (SELECT 'u' || c_nationkey AS user_id, c_name AS label, 'sk-' || sha256(c_name) AS key FROM customer)
SELECT user_id, label, left(key, 8) || '...' || right(key, 4) AS key FROM k WHERE user_id = 'u7'""")
def masked_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark_view(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("user_id"), F.col("c_name").alias("label"), F.concat(F.lit("sk-"), F.sha2("c_name", 256)).alias("key"))
    return control.masked_keys(keys, "u7", False)


@query("SELECT path, security_grade FROM {v_docs} d WHERE security_grade < 3 AND path = '/Shared/it/d21.md'")
def point_read(spark: SparkSession, sf: str) -> DataFrame:
    who = _who(spark, sf, "admin01")
    return spark_view(spark, sf, "v_docs").where((F.col("path") == "/Shared/it/d21.md") & who.allowed(F.col("path"))).where("security_grade < 3").select("path", "security_grade")


@query("""SELECT community, count(*) AS n_matched FROM (SELECT DISTINCT dst AS community, src AS id FROM {v_tree_edges} e) m WHERE id IN ('supplier:1', 'supplier:2', 'nation:3') GROUP BY community""")
def community_overlap(spark: SparkSession, sf: str) -> DataFrame:
    members = spark_view(spark, sf, "v_tree_edges").select(F.col("dst").alias("community"), F.col("src").alias("id")).distinct()
    return retrieval.overlapping_communities(members, spark_view(spark, sf, "v_nodes").where("id in ('supplier:1', 'supplier:2', 'nation:3')"))
