"""Structured Streaming: daily figures, rate limits, deduplication, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.tables import work_folder


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or one file of it, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent) if path.endswith(".parquet") and _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def drained(stream: DataFrame, mode: str = "complete", key: list[str] | None = None, state: str | None = None) -> DataFrame:
    """What the stream gives once all that is there has been read, as a table.

    key: of rows with one key the last batch's stays (update mode).  state: the folder of a stream that is to go on from where it was.
    """
    spark = stream.sparkSession
    out, state = work_folder(spark, "stream-out") if state is None else f"{state}/out", work_folder(spark, "stream-state") if state is None else f"{state}/state"

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{out}/batch=0")
        else:  # a batch that is run again replaces its own rows
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if key:
        rest = [c for c in stream.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*key, *[F.col("_last")[c].alias(c) for c in rest])
    return rows.select(*[c for c in stream.columns if c != "batch"])


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows and sum of values per day and type; days close once the watermark has passed them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def rate_breaches(events: DataFrame, most: int, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Users with more than `most` events in a window."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def compacted_sessions(turns: DataFrame, keep: int = 3, beyond: int = 6) -> DataFrame:
    """Per conversation how many turns it has, how many are kept as they are and how many are folded into its summary, after each batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, folded = state.get if state.exists else (0, 0)
        for frame in frames:
            total += len(frame)
        if total - folded > beyond:
            folded = total - keep
        state.update((total, folded))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [total], "n_kept": [total - folded], "n_folded": [folded]})

    return turns.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, n_turns long, n_kept long, n_folded long", "total long, folded long", "update", GroupStateTimeout.NoTimeout)
