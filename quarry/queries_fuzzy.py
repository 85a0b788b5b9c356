"""Registered queries of fuzzy name matching, with SQL that counts common subsequences in the bits of a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import fuzzy, graphrag, retrieval
from quarry.plans.views import spark_view
from quarry.queries import _MATCH_SQL, query
from quarry.queries_graph import _LOCAL_CTES, _SEEN_SQL, _graph

#: One word, shorter than 1.5 times any name, so that the SQL needs no parts of the query.
_NAME = "EUROP"
_FULL = (1 << len(_NAME)) - 1


def _sim(s: str) -> str:
    places = " ".join(f"WHEN '{c}' THEN {sum(1 << i for i, x in enumerate(_NAME) if x == c)}" for c in sorted(set(_NAME)))
    masks = f"list_transform(string_split({s}, ''), lambda c: CAST(CASE c {places} ELSE 0 END AS BIGINT))"
    left = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & CAST({_FULL} AS BIGINT), CAST({_FULL} AS BIGINT))"
    return f"(CASE WHEN {s} = '' THEN 0.0 ELSE CAST(200 AS DOUBLE) * ({len(_NAME)} - bit_count({left})) / ({len(_NAME)} + length({s})) END)"


def _part(s: str) -> str:
    n = len(_NAME)
    return f"list_max(list_transform(range({1 - n}, length({s})), lambda i: {_sim(f'substring({s}, CAST(greatest(i, 0) + 1 AS BIGINT), CAST(i + {n} - greatest(i, 0) AS BIGINT))')}))"


_WORDS_CTE = "SELECT *, string_split(name, ' ') AS w FROM {v_nodes} n"
_SORTED, _ONCE = "array_to_string(list_sort(w), ' ')", "array_to_string(list_sort(list_distinct(w)), ' ')"
_SCALE = f"CAST(CASE WHEN length(name) <= 8 * {len(_NAME)} THEN 0.9 ELSE 0.6 END AS DOUBLE)"
_BY_WORDS = lambda f: f"CASE WHEN list_contains(w, '{_NAME}') THEN CAST(100 AS DOUBLE) ELSE greatest({f(_SORTED)}, {f(_ONCE)}) END"
_SCORED_SQL = f"""SELECT *, CASE WHEN length(name) < 1.5 * {len(_NAME)} THEN greatest({_sim('name')}, CAST(0.95 AS DOUBLE) * {_BY_WORDS(_sim)})
  ELSE greatest({_sim('name')}, {_SCALE} * {_part('name')}, CAST(0.95 AS DOUBLE) * {_SCALE} * {_BY_WORDS(_part)}) END AS score FROM ({_WORDS_CTE}) x"""
_TOP_SQL = lambda k: f"SELECT * FROM ({_SCORED_SQL}) s ORDER BY score DESC, id LIMIT {k}"
_FUZZY_MATCH_SQL = f"""SELECT id, name, mentions FROM {{v_nodes}} n WHERE contains('{_NAME.lower()}', lower(name)) OR list_contains(regexp_extract_all(lower(name), '[a-zA-Z0-9가-힣-]+'), '{_NAME.lower()}')
  OR id IN (SELECT id FROM ({_TOP_SQL(50)}) t) ORDER BY mentions DESC, id LIMIT 20"""


@query(f"SELECT id, name, round(score, 6) AS score FROM ({_TOP_SQL(20)}) t")
def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.fuzzy_search(spark_view(spark, sf, "v_nodes"), _NAME, limit=20).select("id", "name", F.round("score", 6).alias("score"))


@query(_FUZZY_MATCH_SQL)
def fuzzy_match_entities(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.matched_entities(spark_view(spark, sf, "v_nodes").select("id", "name", "mentions"), _NAME)


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM ({_TOP_SQL(60)}) t WHERE id IN {_SEEN_SQL} ORDER BY score DESC, id LIMIT 20) r")
def readable_fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    entities, _, _, sources, may_read = _graph(spark, sf)
    return fuzzy.readable_fuzzy_search(entities, _NAME, sources, may_read, 20).select("id", F.round("score", 6).alias("score"))


@query(_LOCAL_CTES.replace(_MATCH_SQL, _FUZZY_MATCH_SQL) + " SELECT section, item FROM own UNION ALL SELECT 'source', item FROM source")
def rag_local_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return graphrag.graph_search("local", _NAME, None, None, *_graph(spark, sf))


@query(f"""SELECT id, '{{"name":"' || name || '","type":"' || entity_type || '","properties":""}}' AS text FROM (
SELECT * FROM {{v_nodes}} n WHERE id IN (SELECT id FROM ({_FUZZY_MATCH_SQL}) m) AND id IN {_SEEN_SQL} ORDER BY mentions DESC, id LIMIT 5) y""")
def prompt_context_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    *_, sources, may_read = _graph(spark, sf)
    bare = spark_view(spark, sf, "v_nodes").withColumn("properties", F.create_map().cast("map<string,string>"))
    return graphrag.prompt_context(_NAME, bare, sources, may_read)
