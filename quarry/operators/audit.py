"""Audit log queries, usage and governance figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(**given) -> Column:
    """Only the conditions whose value is given: user_id, skill_name, status, start, end."""
    made = {
        "user_id": lambda v: F.col("user_id") == v,
        "skill_name": lambda v: F.col("skill_name") == v,
        "status": lambda v: F.col("status") == v,
        "start": lambda v: F.col("started_at") >= F.lit(v).cast("timestamp_ntz"),
        "end": lambda v: F.col("started_at") <= F.lit(v).cast("timestamp_ntz"),
    }
    return reduce(lambda a, b: a & b, [made[k](v) for k, v in given.items() if v is not None], F.lit(True))


def page_of(log: DataFrame, limit: int = 50, offset: int = 0, **given) -> DataFrame:
    """Matching rows, newest first."""
    return log.where(where_given(**given)).orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit)


def status_counts(log: DataFrame) -> DataFrame:
    n, ok, bad = F.count(F.lit(1)), F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "error")
    return log.agg(n.alias("total"), ok.alias("success"), bad.alias("error"), (n - ok - bad).alias("other"), F.coalesce(F.round(F.try_divide(ok, n), 4), F.lit(0.0)).alias("success_rate"))


def skill_usage(log: DataFrame) -> DataFrame:
    """Per skill: calls, successes, errors, the mean duration of successes and their share."""
    good = F.col("status") == "success"
    n, ok = F.count(F.lit(1)), F.count_if(good)
    return log.where("skill_name is not null").groupBy("skill_name").agg(
        n.alias("total"), ok.alias("success"), F.count_if(F.col("status") == "error").alias("error"), F.round(F.avg(F.when(good, F.col("duration_s"))), 3).alias("avg_duration_s"), F.round(ok / n, 4).alias("success_rate")
    )


def usage(log: DataFrame, newest: int = 500) -> DataFrame:
    """kind (user, skill, day), label, n over the newest rows: one grouping-sets pass."""
    few = log.orderBy(F.desc("started_at"), F.desc("id")).limit(newest).select("user_id", F.coalesce("skill_name", F.lit("direct")).alias("skill"), F.substring(F.col("started_at").cast("string"), 1, 10).alias("day"))
    sets = few.groupingSets([[F.col("user_id")], [F.col("skill")], [F.col("day")]], F.col("user_id"), F.col("skill"), F.col("day")).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "user").when(F.col("g") == 5, "skill").otherwise("day")
    return sets.select(kind.alias("kind"), F.coalesce("user_id", "skill", "day").alias("label"), "n")


def governance(log: DataFrame) -> DataFrame:
    """Counts of rows, access violations, suspected injections and errors."""
    denied = F.lower("status").contains("denied") | F.col("output_payload").contains("403")
    suspect = F.lower("reasoning").contains("injection") | F.lower("output_payload").contains("injection")
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(denied).alias("violations"), F.count_if(suspect).alias("injections"), F.count_if(F.col("status") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


def newest_days(log: DataFrame, days: int = 7) -> DataFrame:
    """Rows of the newest days that have any: the days are few, one row each."""
    day = F.substring(F.col("started_at").cast("string"), 1, 10)
    wanted = log.select(day.alias("day")).distinct().orderBy(F.desc("day")).limit(days)
    return log.withColumn("day", day).join(F.broadcast(wanted), "day", "left_semi").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def provenance(answers: DataFrame) -> DataFrame:
    """Answer records as logged: cut previews, the highest grade, and flags for grades 2 and 3.  answers: id, query, response, grades array."""
    return answers.select(
        "id", F.left("query", F.lit(500)).alias("query"), F.left("response", F.lit(200)).alias("response_preview"), F.coalesce(F.array_max("grades"), F.lit(1)).alias("max_security_grade"),
        F.array_contains("grades", 2).alias("grade_2_accessed"), F.array_contains("grades", 3).alias("grade_3_accessed"),
    )


def load_signal(slots: DataFrame) -> DataFrame:
    """Per server the share of busy slots in whole percent, and green, yellow or red.  slots: server, state."""
    pct = F.floor(F.count_if(F.col("state") != 0) * 100 / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("int")
    return slots.groupBy("server").agg(pct.alias("load")).select("server", "load", F.when(F.col("load") < 40, "green").when(F.col("load") < 75, "yellow").otherwise("red").alias("signal"))


def metric_lines(text: DataFrame) -> DataFrame:
    """name, value of every sample line of a metrics page, labels left aside.  text: body."""
    line = text.select(F.explode(F.split("body", "\n")).alias("s")).where(~F.col("s").startswith("#") & (F.trim("s") != ""))
    name, value = F.regexp_extract("s", r"^([A-Za-z_:][\w:]*)", 1), F.regexp_extract("s", r"\s(\S+)\s*$", 1)
    return line.select(name.alias("name"), value.try_cast("double").alias("value")).where("value is not null")


def grade_shares(docs: DataFrame) -> DataFrame:
    """grade, n, share in percent of all documents."""
    counts = docs.groupBy(F.coalesce("security_grade", F.lit(1)).alias("grade")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def error_rate(rows: DataFrame) -> DataFrame:
    """Rows, errors and the share of errors in per cent, one place."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors")).withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("errors") * 100.0 / F.col("n"), 1)).otherwise(0.0))


def layer_totals(base: DataFrame, personal: DataFrame) -> DataFrame:
    """Nodes of the base and of the personal layer and their sum (an id in both counts twice)."""
    rows = base.select(F.lit(True).alias("base")).unionByName(personal.select(F.lit(False).alias("base")))
    return rows.agg(F.count_if("base").alias("base"), F.count_if(~F.col("base")).alias("personal"), F.count(F.lit(1)).alias("total"))


def user_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """user_id, n_nodes, n_edges of every personal graph."""
    n = nodes.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "user_id", "full").select("user_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
