"""Where results go: graph snapshots, audit records, provenance by day, session memos."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.tables import files_of, whole_tables


#: Snapshots of a graph that stay: the newest, and one that readers may still be at.
SNAPSHOTS = 2


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, keep: int = SNAPSHOTS) -> None:
    """A snapshot of the graph, two Parquet tables.

    It counts once its head, a row that names its folder, is there: a reader sees both tables of one snapshot, and a job that breaks
    off leaves the one before in force.  Of two writers of one number the second fails.  Older snapshots but for `keep` go.
    """
    spark = nodes.sparkSession
    heads = sorted(map(int, whole_tables(spark, f"{folder}/heads")))
    data = f"{folder}/data/{uuid.uuid4().hex}"
    nodes.write.parquet(f"{data}/nodes")
    edges.write.parquet(f"{data}/edges")
    spark.range(1).select(F.lit(data).alias("data")).coalesce(1).write.json(f"{folder}/heads/{heads[-1] + 1 if heads else 0}")
    for old in heads[: len(heads) + 1 - keep]:
        gone = _head(spark, folder, old)
        for path in (f"{folder}/heads/{old}", gone):
            files, at = files_of(spark, path)
            files.delete(at, True)


def _head(spark: SparkSession, folder: str, number: int) -> str:
    return spark.read.schema("data string").json(f"{folder}/heads/{number}").first()["data"]


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the newest whole snapshot."""
    heads = whole_tables(spark, f"{folder}/heads")
    if not heads:
        raise ValueError(f"no graph in {folder}")
    data = _head(spark, folder, max(map(int, heads)))
    return spark.read.parquet(f"{data}/nodes"), spark.read.parquet(f"{data}/edges")


def append_audit(records: DataFrame, folder: str, payloads: tuple[str, ...] = ("input_payload", "output_payload")) -> None:
    """Audit records are appended; payloads that are structs or maps become JSON text."""
    kinds = dict(records.dtypes)
    as_text = {c: F.to_json(c) for c in payloads if kinds.get(c, "string").startswith(("struct", "map", "array"))}
    records.withColumns(as_text).write.mode("append").parquet(folder)


def read_audit(spark: SparkSession, folder: str, user: str | None = None, thread: str | None = None, limit: int = 100) -> DataFrame:
    """The newest records, of one user or thread where given; the filters reach the scan."""
    rows = spark.read.parquet(folder)
    rows = rows.where(F.col("user_id") == user) if user else rows
    rows = rows.where(F.col("thread_id") == thread) if thread else rows
    return rows.orderBy(F.desc("started_at"), "id").limit(limit)


def append_provenance(records: DataFrame, folder: str, day: str = "day") -> None:
    """One JSON line a record, in a folder for each day."""
    records.write.mode("append").partitionBy(day).json(folder)


def read_provenance(spark: SparkSession, folder: str, schema: str, day: str | None = None, newest: int = 7) -> DataFrame:
    """Records of one day, or of the newest days that there are; lines that are no JSON are left out.  The days are read off the names of the folders, so only theirs are opened."""
    rows = spark.read.schema(f"{schema}, day string").option("mode", "DROPMALFORMED").option("basePath", folder).json(folder)
    if day:
        return rows.where(F.col("day") == day)
    named = {unquote(unquote(found[1])) for path in rows.inputFiles() if (found := re.search(r"/day=([^/]+)/", path))}
    return rows.where(F.col("day").isin(sorted(named - {"__HIVE_DEFAULT_PARTITION__"})[-newest:]))


def append_memos(memos: DataFrame, folder: str, before: DataFrame | None = None) -> None:
    """Memos of threads, numbered on within each thread; one writer at a time.  memos: thread_id, ord, text; before: what the folder holds."""
    last = before.groupBy("thread_id").agg(F.max("memo_id").alias("_last")) if before is not None else None
    rows = memos.join(last, "thread_id", "left") if last is not None else memos.withColumn("_last", F.lit(0))
    number = F.row_number().over(Window.partitionBy("thread_id").orderBy("ord")) + F.coalesce("_last", F.lit(0))
    rows.select("thread_id", number.cast("long").alias("memo_id"), "text").write.mode("append").parquet(folder)
