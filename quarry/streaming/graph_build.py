"""A graph build that goes on where it stopped, with errors as rows and rounds of retries.

Files come as a stream, a few at a time; the stream's checkpoint says which
were dealt with.  What an attempt finds (raw entities, raw edges), how each
file fared (status) and the files to try again (failed) are tables below the
store, one folder for each batch or round, written over if it is run again.
When the stream is at its end, the failed files alone go through the extractor
again with twice and four times the budget.  The graph is the upsert of all
raw rows, so a build that was broken off and went on gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import base_name
from quarry.operators.extract import ANSWER, raw_edges, raw_entities
from quarry.operators.graph import stub_nodes, upsert_edges, upsert_entities
from quarry.sources.tables import removed, written

Extractor = Callable[[DataFrame], DataFrame]
#: Seconds for 8 KB, three times as many for files of this name (fixed values).
BASE_S, BASE_KB, HEAVY, HEAVY_TIMES = 600, 8, "사업방법서", 3
#: Rounds of retries, each with twice the budget of the one before; files of a batch.
ROUNDS, FILES = 2, 20
STATUS = "doc_id long, path string, round int, error string"


def budget(text: Column, path: Column, times: int = 1) -> Column:
    """Seconds that a file may take: in proportion to its size, not less than for 8 KB."""
    kb = F.greatest(F.octet_length(F.coalesce(text, F.lit(""))) / 1024, F.lit(float(BASE_KB)))
    return F.floor(BASE_S * (kb / BASE_KB) * F.when(F.contains(base_name(path), F.lit(HEAVY)), HEAVY_TIMES).otherwise(1) * times)


def called_answers(docs: DataFrame, call: Callable[[str, float], str]) -> DataFrame:
    """docs with answer and error: call(text, seconds) gives the answer as JSON; what it raises, or an answer that is no such JSON, is the file's error."""

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, seconds in frames:
            found = []
            for text, most in zip(texts, seconds):
                try:
                    found.append((call(text or "", float(most)), None))
                except Exception as e:  # noqa: BLE001  every failure is a row
                    found.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"json": pd.Series([j for j, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    told = docs.withColumn("_r", F.pandas_udf(run, "json string, error string")("text", F.col("budget_s").cast("double")))
    answer = F.from_json(F.col("_r.json"), ANSWER)
    unread = F.col("_r.error").isNull() & F.try_parse_json(F.col("_r.json")).isNull()
    return told.withColumns({"answer": answer, "error": F.when(unread, "no JSON").otherwise(F.col("_r.error"))}).drop("_r")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def attempt(docs: DataFrame, extract: Extractor, store: str, label: str, number: int) -> None:
    """One pass of the extractor over docs (doc_id, path, text): its tables, the status last."""
    given = docs.select("doc_id", "path", "text", F.lit(number).alias("round"), budget(F.col("text"), F.col("path"), 2**number).alias("budget_s"))
    told = extract(given)
    told = written(told if "error" in told.columns else told.withColumn("error", F.lit(None).cast("string")), "answers")
    good = told.where("error is null and answer is not null")
    entities = raw_entities(good)
    entities.write.mode("overwrite").parquet(f"{store}/entities/{label}")
    raw_edges(good, entities).write.mode("overwrite").parquet(f"{store}/edges/{label}")
    fared = told.withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer"))).otherwise(F.col("error")))
    fared.where("error is not null").select("doc_id", "path", "text", "round").write.mode("overwrite").parquet(f"{store}/failed/{label}")
    fared.select("doc_id", "path", "round", "error").write.mode("overwrite").parquet(f"{store}/status/{label}")
    removed(told)


def build_status(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, path, round (of the last attempt), error (null where it went well)."""
    every = spark.read.schema(STATUS).parquet(f"{store}/status/*")
    return every.groupBy("doc_id", "path").agg(F.max_by(F.struct("round", "error"), "round").alias("last")).select("doc_id", "path", "last.round", "last.error")


def build_progress(spark: SparkSession, store: str) -> DataFrame:
    """round, n_done, n_failed: how many files have their last attempt in each round, and how it ended."""
    return build_status(spark, store).groupBy("round").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("n_done"), F.count("error").alias("n_failed"))


def _last_batch(spark: SparkSession, store: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/status")
    names = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return max(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))


def build_graph(files: DataFrame, extract: Extractor, store: str, rounds: int = ROUNDS) -> None:
    """Runs or goes on with a build: the files that are new, then rounds of retries for those of them that failed.

    files: a stream of doc_id, path, text.  A file that failed in all rounds is not tried again; its error stays in build_status.
    """
    spark = files.sparkSession
    put = lambda batch, number: attempt(batch, extract, store, f"batch-{number}", 0)
    files.writeStream.option("checkpointLocation", f"{store}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if not _exists(spark, f"{store}/status"):  # no file yet
        return
    run = _last_batch(spark, store)
    for number in range(1, rounds + 1):
        label = f"retry-{run}-{number}"
        if _exists(spark, f"{store}/status/{label}/_SUCCESS"):
            continue
        due = build_status(spark, store).where((F.col("round") == number - 1) & F.col("error").isNotNull()).select("doc_id", "path", "round")
        failed = spark.read.schema("doc_id long, path string, text string, round int").parquet(f"{store}/failed/*")
        # read to the end before anything is written where it is read from
        docs = written(failed.join(due, ["doc_id", "path", "round"], "left_semi").drop("round"), "retries")
        attempt(docs, extract, store, label, number)
        removed(docs)


def built_graph(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all that was found so far: id, name, entity_type, mentions, with nodes for ends that nothing names; src, dst, relation_type, source_path, weight."""
    raw = spark.read.parquet(f"{store}/entities/*")
    events = raw.withColumn("p", F.explode_outer(F.map_entries("properties"))).select("id", "name", "entity_type", "ord", "source_path", F.col("p.key").alias("prop_key"), F.col("p.value").alias("prop_value"))
    once = raw.select("id", "name", "entity_type", "ord", "source_path", F.lit(None).cast("string").alias("prop_key"), F.lit(None).cast("string").alias("prop_value"))
    nodes = upsert_entities(once).select("id", "name", "entity_type", F.col("mentions").cast("long").alias("mentions"), "source_paths")
    properties = upsert_entities(events).select("id", "properties")
    nodes = nodes.join(properties, "id", "left")
    edges = upsert_edges(spark.read.parquet(f"{store}/edges/*"))
    stubs = stub_nodes(edges, nodes).withColumns({"source_paths": F.array().cast("array<string>"), "properties": F.lit(None).cast("map<string,string>")})
    return nodes.unionByName(stubs), edges
