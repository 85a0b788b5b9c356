"""An edge table that a stream keeps up to date: hash buckets, written anew only where a batch touches them.

Below the store's folder, ``data/v<batch>/bucket=<k>`` holds what a batch wrote
of bucket k, ``manifests/m<batch>`` says for every bucket which version is in
force.  A batch reads and writes only the buckets that its edges fall in; it
counts once its manifest is there, so a reader never sees half of it, and a
batch that is run again starts from the manifest before it and gives the same.
Rows keep the first weight and the number of rows, so that folding batches is
the upsert of all rows at once, whatever their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import files_of, whole_tables

#: Buckets of a store that is made without a number: a bucket should hold some hundred MB.
BUCKETS = 64
#: What is kept of the first row of an edge, where events have it.
FIRST = ("relation_type", "source_path", "weight", "properties")


def _manifests(spark: SparkSession, store: str) -> list[int]:
    """The numbers of all whole manifests."""
    return sorted(int(name[1:]) for name in whole_tables(spark, f"{store}/manifests"))


def _manifest(spark: SparkSession, store: str, number: int) -> dict[int, int]:
    """bucket: version of one manifest; as many rows as there are buckets at most."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").json(f"{store}/manifests/m{number}").collect()}


def _remove(spark: SparkSession, folder: str) -> None:
    files, path = files_of(spark, folder)
    files.delete(path, True)


def _read(spark: SparkSession, store: str, held: dict[int, int], schema) -> DataFrame:
    paths = [f"{store}/data/v{version}/bucket={bucket}" for bucket, version in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fold_batch(batch: DataFrame, store: str, number: int, buckets: int = BUCKETS) -> None:
    """Folds the raw edges of one batch into the store.  batch: src, dst, ord, and of FIRST what there is."""
    spark = batch.sparkSession
    kept = [c for c in FIRST if c in batch.columns]
    rows = batch.select("src", "dst", "ord", F.struct(*kept).alias("first"), F.lit(1).cast("long").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("src", "dst"), F.lit(buckets)).cast("int"))
    merged = lambda df: df.groupBy("bucket", "src", "dst").agg(F.min_by("first", "ord").alias("first"), F.sum("n").alias("n"), F.min("ord").alias("ord"))
    fresh = merged(rows).persist()
    before = max((m for m in _manifests(spark, store) if m < number), default=None)
    held = {} if before is None else _manifest(spark, store, before)
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # buckets at most
    plain = fresh.drop("bucket").schema
    old = _read(spark, store, {b: held[b] for b in touched if b in held}, plain)
    both = fresh.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64("src", "dst"), F.lit(buckets)).cast("int")))
    if touched:
        merged(both).repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/data/v{number}")
    fresh.unpersist()
    now = held | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{store}/manifests/m{number}")
    _tidy(spark, store, number)


def _tidy(spark: SparkSession, store: str, number: int) -> None:
    """Removes manifests before the last two, and buckets that neither of these names."""
    *old, before, now = [-1, -1, *[m for m in _manifests(spark, store) if m <= number]]
    live = {pair for m in (before, now) if m >= 0 for pair in _manifest(spark, store, m).items()}
    for m in (m for m in old if m >= 0):
        for bucket, version in _manifest(spark, store, m).items():
            if (bucket, version) not in live:
                _remove(spark, f"{store}/data/v{version}/bucket={bucket}")
        _remove(spark, f"{store}/manifests/m{m}")


def edge_table(spark: SparkSession, store: str) -> DataFrame:
    """src, dst, weight (the first one and one more for each further row), what else the first row had, ord, n, as the last whole manifest has it."""
    last = max(_manifests(spark, store))
    held = _manifest(spark, store, last)
    bucket, version = min(held.items())
    rows = _read(spark, store, held, spark.read.parquet(f"{store}/data/v{version}/bucket={bucket}").schema)
    kept = [f.name for f in rows.schema["first"].dataType.fields]
    columns = [((F.col("first.weight") + F.col("n") - 1) if c == "weight" else F.col(f"first.{c}")).alias(c) for c in kept]
    return rows.select("src", "dst", *columns, "ord", "n")


def incremental_edges(events: DataFrame, store: str, buckets: int = BUCKETS) -> DataFrame:
    """Folds a stream of raw edges into the store and gives the table as it then is; the next run goes on from there."""
    put = lambda batch, number: fold_batch(batch, store, number, buckets)
    events.writeStream.option("checkpointLocation", f"{store}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return edge_table(events.sparkSession, store)
