"""Documents as a versioned, governed table: metadata, versions, writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_metadata(defaults: Column, existing: Column, extra: Column) -> Column:
    """Maps merged so that extra beats existing beats defaults; created_at falls back to updated_at."""
    beaten = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    both = beaten(beaten(defaults, existing), extra)
    made = F.try_element_at(both, F.lit("updated_at"))
    add = F.when(~F.map_contains_key(both, "created_at") & made.isNotNull(), F.create_map(F.lit("created_at"), made)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(both, add)


def current(versions: DataFrame) -> DataFrame:
    """The newest version of every path."""
    return versions.groupBy("path").agg(F.max_by("commit_hash", F.struct("ts", "commit_hash")).alias("commit_hash"), F.count(F.lit(1)).alias("n_versions"))


def as_of(versions: DataFrame, ts: int) -> DataFrame:
    """The version of every path that was current at ts."""
    return versions.where(F.col("ts") <= ts).groupBy("path").agg(F.max_by("commit_hash", F.struct("ts", "commit_hash")).alias("commit_hash"), F.max("ts").alias("ts"))


def at_commit(versions: DataFrame, path: str, prefix: str) -> DataFrame:
    """One path at a commit named by a prefix of 4 to 40 hexadecimal digits; nothing for another prefix."""
    import re

    good = re.fullmatch("[0-9a-fA-F]{4,40}", prefix) is not None
    return versions.where((F.col("path") == path) & F.startswith("commit_hash", F.lit(prefix)) & F.lit(good))


def history(versions: DataFrame, skip: int = 1, most: int = 10) -> DataFrame:
    """Older versions of every path, the newest first, without the current one."""
    order = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("commit_hash"))
    return versions.withColumn("n", F.row_number().over(order)).where(F.col("n").between(skip + 1, skip + most))


def rolled_back(versions: DataFrame, path: str, commit: str, ts: int) -> DataFrame:
    """The log with one more version of the path: its content at the commit."""
    again = at_commit(versions, path, commit).withColumn("ts", F.lit(ts).cast("long")).withColumn("commit_hash", F.lit("rollback"))
    return versions.unionByName(again)


def reprocessed(docs: DataFrame, cleaned: Column, text: str = "md") -> DataFrame:
    """Only rows that the cleaning changes, with the new text; cleaned once (as a column, the filter would be pushed below it and clean again)."""
    return docs.select("*", F.explode(F.array(cleaned)).alias("_new")).where(F.trim("_new") != F.trim(text)).withColumn(text, F.col("_new")).drop("_new")


def not_done(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose file name does not occur among the paths done."""
    name = lambda c: F.substring_index(c, "/", -1)
    return docs.withColumn("_b", name(F.col("path"))).join(done.select(name(F.col("source_path")).alias("_b")).distinct(), "_b", "left_anti").drop("_b")


def updated_permissions(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """allowed_role replaced where an update names the path.  updates: path, allowed_role."""
    new = updates.groupBy("path").agg(F.max("allowed_role").alias("_new"))
    return docs.join(new, "path", "left").withColumn("allowed_role", F.coalesce("_new", "allowed_role")).drop("_new")


def tree_nodes(docs: DataFrame) -> DataFrame:
    """path, is_file, depth of every folder and file of a listing."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    n = F.size("p")
    every = docs.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), n)).alias("d"))
    return every.select(F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("d")), "/")).alias("path"), (F.col("d") == n).alias("is_file"), F.col("d").alias("depth")).distinct()


def reindex_summary(results: DataFrame) -> DataFrame:
    """results: path, n (chunks; 0 skipped, -1 failed)."""
    return results.agg(F.count_if(F.col("n") > 0).alias("indexed"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("chunks"), F.count_if(F.col("n") < 0).alias("errors"), F.count_if(F.col("n") == 0).alias("skipped"))
