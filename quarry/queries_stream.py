"""Registered queries of builds that go on and of kill switches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import extract
from quarry.plans.views import VIEWS, spark_view
from quarry.queries import query
from quarry.streaming import flows, graph_build, switch

_TERMS = ("License", "disgusting", "stupid", "worthless")


def _flaky(docs: DataFrame) -> DataFrame:
    """The default extractor, failing for some files in the first rounds and for a few in all."""
    told = extract.dictionary_answers(docs, dict.fromkeys(_TERMS, "condition"))
    fails = F.when(F.col("doc_id") % 343 == 0, 9).when(F.col("doc_id") % 49 == 0, 2).when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return told.withColumn("error", F.when(F.col("round") < fails, F.lit("timed out")))


def _built(spark: SparkSession, sf: str) -> str:
    store = flows.work_folder(spark, "build")
    files = spark.sql(VIEWS["v_docs"], documents=flows.table_stream(spark, f"{sf}/documents.parquet")).select("doc_id", "path", "text")
    graph_build.build_graph(files, _flaky, store)
    return store


_FOUND_SQL = f"""WITH f AS (SELECT doc_id, list_filter({list(_TERMS)}, lambda t: contains(lower(text), lower(t))) AS l FROM documents WHERE doc_id % 343 <> 0)"""


@query(_FOUND_SQL + " SELECT lower(l[k]) AS src, lower(l[k + 1]) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT l, unnest(range(1, len(l))) AS k FROM f) x GROUP BY 1, 2")
def graph_build_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph_build.built_graph(spark, _built(spark, sf))[1].select("src", "dst", F.col("weight").cast("double").alias("weight"))


@query(_FOUND_SQL + " SELECT lower(t) AS id, t AS name, count(*) AS mentions FROM (SELECT unnest(l) AS t FROM f) x GROUP BY 1, 2")
def graph_build_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_build.built_graph(spark, _built(spark, sf))[0].select("id", "name", "mentions")


@query("""SELECT CAST(r AS INT) AS round, count(*) FILTER (doc_id % 343 <> 0) AS n_done, count(*) FILTER (doc_id % 343 = 0) AS n_failed
FROM (SELECT doc_id, CASE WHEN doc_id % 49 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS r FROM documents) d GROUP BY 1""")
def graph_build_progress(spark: SparkSession, sf: str) -> DataFrame:
    return graph_build.build_progress(spark, _built(spark, sf))


_HISTORY = 20
_EVENTS = """SELECT concat('u', CAST(user_id % 40 AS STRING)) AS switch, date_trunc('second', ts) AS ts, event_id AS ord, event_type = 'error' AS activate,
  concat('value ', CAST(CAST(floor(value) AS INT) AS STRING)) AS reason, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 3600 * CAST(1 + event_id % 7 AS INT) END AS seconds
FROM {events} WHERE event_type IN ('error', 'signup')"""
_CHANGES_SQL = f"""WITH e AS (SELECT *, ts + to_seconds(coalesce(seconds, 0)) AS ending, max(ts) OVER () AS newest,
    lead(ts) OVER w AS next_ts, lag(activate) OVER w AS was_on, lag(seconds) OVER w AS was_seconds, lag(ts) OVER w AS was_ts FROM ({_EVENTS.replace('{events}', 'events')}) x WINDOW w AS (PARTITION BY switch ORDER BY ts, ord)),
c AS (
  SELECT switch, ts AS moment, 'activated' AS event, reason, 1 AS side, ord FROM e WHERE activate
  UNION ALL SELECT switch, ending, 'timed out', reason, 0, ord FROM e WHERE activate AND seconds IS NOT NULL AND coalesce(next_ts, newest) >= ending
  UNION ALL SELECT switch, ts, 'deactivated', reason, 1, ord FROM e WHERE NOT activate AND was_on AND (was_seconds IS NULL OR was_ts + to_seconds(was_seconds) > ts)),
changes AS (SELECT *, row_number() OVER (PARTITION BY switch ORDER BY moment, side, ord) AS nth FROM c),
active AS (SELECT switch FROM changes QUALIFY row_number() OVER (PARTITION BY switch ORDER BY nth DESC) = 1 AND event = 'activated')"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.sql(_EVENTS, events=flows.table_stream(spark, f"{sf}/events.parquet"))
    return switch.changes_table(events, history=_HISTORY)


@query(_CHANGES_SQL + f" SELECT switch, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, event, reason, CAST(least(nth, {_HISTORY}) AS INT) AS n_kept FROM changes")
def switch_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("switch", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("moment"), "event", "reason", "n_kept")


@query(_CHANGES_SQL + " SELECT o_orderkey FROM orders WHERE concat('u', CAST(o_custkey % 40 AS STRING)) NOT IN (SELECT switch FROM active)")
def switch_guarded(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark_view(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("u"), (F.col("o_custkey") % 40).cast("string")).alias("key"))
    return switch.guarded(orders, _changes(spark, sf), "key").select("o_orderkey")
