"""What the services around the engine ask for: listings, storage and upload figures, callers, plans and their execution logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.readers import HIDDEN_ROOTS

#: Names of relations as they are shown (fixed values).
RELATION_LABELS = {
    "covers": "보장",
    "includes": "포함",
    "excludes": "면책",
    "requires": "요건",
    "depends_on": "의존",
    "regulates": "규제",
    "belongs_to": "소속",
    "references": "참조",
    "defines": "정의",
    "diagnoses": "진단",
    "pays": "지급",
    "renews_as": "갱신",
    "supersedes": "대체",
    "must_coexist": "의무동시가입",
}
#: Systems that old requests may name (fixed values).
SYSTEMS = ("core", "uw", "policy", "claim", "customer")
#: States in which an upload or a task is over (fixed values).
UPLOADED, ENDED = ("ingested", "saved"), ("completed", "failed", "cancelled")
#: A call is tried three times; the waits between are 1 and 2 seconds.
ATTEMPTS, FIRST_WAIT = 3, 1.0
LISTED, KNOWN_NAMES = 200, 200


def permission_listing(docs: DataFrame, first: int = LISTED) -> DataFrame:
    """Permissions of the first documents by path; of these, those in hidden folders are left out."""
    steps = F.split(F.ltrim(F.col("path"), F.lit("/")), "/")
    page = docs.withColumn("_steps", steps).orderBy("_steps").limit(first)
    return page.where(~F.col("_steps")[0].isin(*HIDDEN_ROOTS)).select("path", "owner", "allowed_role", "allowed_department", "effective_date")


def storage_totals(texts: DataFrame, text: str = "text") -> DataFrame:
    """n_files and their megabytes."""
    return texts.agg(F.count(F.lit(1)).alias("n_files"), (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / F.lit(1048576.0)).alias("megabytes"))


def upload_summary(uploads: DataFrame) -> DataFrame:
    """total, success, errors of uploads by their status; one without a status is an error."""
    good = F.count_if(F.col("status").isin(*UPLOADED))
    return uploads.agg(F.count(F.lit(1)).alias("total"), good.alias("success"), (F.count(F.lit(1)) - good).alias("errors"))


def build_stats(built: DataFrame) -> DataFrame:
    """section, item, n of a graph build: the documents processed, what they gave, and a row for each error.  built: path, n_entities, n_relationships, error."""
    totals = built.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("n_relationships"), F.lit(0)).alias("relationships"))
    rows = totals.select(F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("item"), F.col(c).alias("n")) for c in totals.columns])))
    errors = built.where("error <> ''").select(F.lit("error").alias("section"), F.concat_ws(": ", "path", "error").alias("item"), F.lit(1).cast("long").alias("n"))
    return rows.unionByName(errors)


def admitted(requests: DataFrame, servers: DataFrame, users: DataFrame) -> DataFrame:
    """Requests of known users to a registered server (or to none in particular) and a known system.  requests: user_id, url, system."""
    known = requests.where(F.col("system").isin(*SYSTEMS)).join(users.select("user_id"), "user_id", "left_semi")
    listed = servers.select(F.col("url").alias("_url")).distinct()
    return known.join(listed, F.col("url") == F.col("_url"), "left").where("url is null or _url is not null").drop("_url")


def with_installed(offers: DataFrame, installed: DataFrame) -> DataFrame:
    """Offers with a flag for those that a user has.  offers: skill; installed: skill."""
    return offers.join(installed.select("skill").distinct().withColumn("installed", F.lit(True)), "skill", "left").withColumn("installed", F.coalesce("installed", F.lit(False)))


def with_department(users: DataFrame, departments: DataFrame) -> DataFrame:
    """Users with the name of their department, its code where it has no name.  departments: department, department_name."""
    return users.join(departments, "department", "left").withColumn("department_name", F.coalesce("department_name", "department"))


def workspace_of(path: Column, tab: str) -> Column:
    """Whether a path is shown under a tab: all, or one of the top folders."""
    return F.lit(True) if tab == "all" else F.startswith(F.ltrim(path, F.lit("/")), F.lit(tab + "/"))


def known_names(events: DataFrame, most: int = KNOWN_NAMES) -> DataFrame:
    """id, name of the entities seen first, which a prompt names as known (a prompt is bounded).  events: id, name, ord."""
    first = events.groupBy("id").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    return first.orderBy("ord", "id").limit(most).select("id", "name")


def stale(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Tasks that ended more than some hours ago.  tasks: status, completed_at."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("completed_at").cast("timestamp"))
    return tasks.where(F.col("status").isin(*ENDED) & (age > hours * 3_600_000_000))


def best_tables(found: DataFrame, page: Sequence[str] = ("page",)) -> DataFrame:
    """The table with most rows on every page, the first of equals.  found: page, table_no, n_rows."""
    return found.groupBy(*page).agg(F.max_by("table_no", F.struct("n_rows", -F.col("table_no"))).alias("table_no"), F.max("n_rows").alias("n_rows"))


def ordered_plans(items: DataFrame, registry: DataFrame) -> DataFrame:
    """run, step, skill, method, endpoint: every run's items after what they depend on, by position among equals; a run with a cycle keeps its order.

    items: run, pos, skill, depends_on; the registry's data are those that count, skills it does not know are left out.  A plan is a few
    steps, so a run is one row: a level is one more than the highest of its needs, found in as many rounds as there are steps.
    """
    known = items.join(registry.select("skill", "method", "endpoint"), "skill")
    plan = known.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "skill", "depends_on", "method", "endpoint"))).alias("p"))

    def level(now: Column, item: Column) -> Column:
        needs = F.zip_with("p", now, lambda other, at: F.when(F.array_contains(item["depends_on"], other["skill"]), at + 1).otherwise(0))
        return F.coalesce(F.array_max(needs), F.lit(0))

    rounds = F.sequence(F.lit(1), F.size("p"))
    levels = F.aggregate(rounds, F.transform("p", lambda _: F.lit(0)), lambda now, _: F.transform("p", lambda item: level(now, item)))
    placed = plan.withColumn("levels", levels)
    cyclic = F.array_max("levels") >= F.size("p")
    rows = F.array_sort(F.zip_with("p", "levels", lambda item, at: F.struct(F.when(cyclic, 0).otherwise(at).alias("level"), item["pos"].alias("pos"), item.alias("item"))))
    return placed.select("run", F.posexplode(rows).alias("step", "x")).select("run", F.col("step").cast("int").alias("step"), "x.item.skill", "x.item.method", "x.item.endpoint")


def execution_log(tries: DataFrame) -> DataFrame:
    """One row for each step of a run: status, attempts, waited seconds, sizes in bytes, output or error.

    tries: run, step, skill, attempt (from 1), ok, input, output, error.  The first attempt that succeeds ends a step; after the third it has failed.
    """
    counted = tries.where(F.col("attempt") <= ATTEMPTS)
    by = counted.groupBy("run", "step", "skill").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"),
        F.max("attempt").alias("last"),
        F.min_by("output", F.when(F.col("ok"), F.col("attempt"))).alias("output"),
        F.max_by("error", F.when(~F.col("ok"), F.col("attempt"))).alias("failure"),
        F.min_by("input", "attempt").alias("input"),
    )
    good = F.col("won").isNotNull()
    attempts = F.coalesce("won", "last")
    return by.select(
        "run",
        "step",
        "skill",
        F.when(good, "success").otherwise("error").alias("status"),
        attempts.alias("attempts"),
        (F.lit(FIRST_WAIT) * (F.pow(F.lit(2.0), attempts - 1) - 1)).alias("waited"),
        F.octet_length(F.coalesce("input", F.lit(""))).cast("long").alias("input_bytes"),
        F.when(good, F.octet_length(F.coalesce("output", F.lit("")))).otherwise(0).cast("long").alias("output_bytes"),
        F.when(good, F.col("output")).alias("output"),
        F.when(~good, F.col("failure")).alias("error"),
    )


def execution_summary(log: DataFrame) -> DataFrame:
    """run, summary, failures: a run's log as lines, step after step, and its failed steps (labels are fixed values)."""
    good = F.col("status") == "success"
    head = F.format_string("[%s] Step %d: %s (attempts=%d, in=%dB, out=%dB)", F.when(good, "OK").otherwise("FAIL"), "step", "skill", "attempts", "input_bytes", "output_bytes")
    below = F.when(good & (F.coalesce("output", F.lit("")) != ""), F.concat(F.lit("\n  Output: "), F.left("output", F.lit(200)))).when(~good, F.concat(F.lit("\n  Error: "), F.coalesce("error", F.lit("unknown error"))))
    failed = F.when(~good, F.concat(F.lit("- 스킬 '"), "skill", F.lit("' (Step "), F.col("step").cast("string"), F.lit(") 실패: "), F.coalesce("error", F.lit("알 수 없는 오류"))))
    rows = log.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", F.concat(head, F.coalesce(below, F.lit(""))).alias("line"), failed.alias("failed")))).alias("x"))
    return rows.select("run", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("summary"), F.array_join(F.transform("x", lambda r: r["failed"]), "\n").alias("failures"))


def fallback_answer(hits: DataFrame, most: int = 5, shown: int = 300) -> DataFrame:
    """answer: the best passages, numbered, as the answer where no model gives one (their number is the feature).  hits: doc_id, score, path, text."""
    top = hits.orderBy(F.desc("score"), "doc_id").limit(most).select(F.struct((-F.col("score")).alias("s"), "doc_id", "path", F.left("text", F.lit(shown)).alias("t")).alias("x"))
    part = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["path"], F.lit("\n"), x["t"])
    return top.agg(F.concat(F.lit("검색 결과:\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), part), "\n\n")).alias("answer"))
