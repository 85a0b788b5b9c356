"""Skill graphs, session memory and the underwriting rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import written


def closure(deps: DataFrame, start: str | None = None) -> DataFrame:
    """skill, needs: everything that a skill rests on, directly or not (itself too, if it lies on a cycle).

    For one skill the frontier goes a step a round; for all of them paths double, so rounds grow with the logarithm of the longest.
    """
    edges = written(deps.select("skill", F.col("dep").alias("needs")).distinct())
    found = edges.where(F.col("skill") == start) if start else edges
    frontier = found
    while True:
        ahead = edges if start else found
        step = frontier.join(ahead.select(F.col("skill").alias("needs"), F.col("needs").alias("further")), "needs").select("skill", F.col("further").alias("needs")).distinct()
        fresh = written(step.join(found, ["skill", "needs"], "left_anti"))
        if not fresh.take(1):
            return found
        found = written(found.unionByName(fresh))
        frontier = fresh if start else found


def levels(skills: DataFrame, deps: DataFrame) -> DataFrame:
    """skill, level (0 needs nothing, else one more than the highest it needs); skills on a cycle, or that need one, have a null level.

    A round peels all skills whose needs are all placed, and the dependencies on them; only known skills count as needs.
    """
    left = written(skills.select("skill").where("skill is not null").distinct())
    known = left.select(F.col("skill").alias("dep"))
    needs = written(deps.select("skill", "dep").distinct().join(left, "skill", "left_semi").join(known, "dep", "left_semi").select("skill", "dep"))
    placed, level = None, 0
    while True:
        ready = written(left.join(needs.select("skill").distinct(), "skill", "left_anti"))
        if not ready.take(1):
            rest = left.select("skill", F.lit(None).cast("int").alias("level"))
            return rest if placed is None else placed.unionByName(rest)
        now = ready.select("skill", F.lit(level).alias("level"))
        placed = now if placed is None else placed.unionByName(now)
        left = written(left.join(ready, "skill", "left_anti"))
        needs = written(needs.join(ready.select(F.col("skill").alias("dep")), "dep", "left_anti").select("skill", "dep"))
        level += 1


def execution_plan(skills: DataFrame, deps: DataFrame, target: str) -> DataFrame:
    """step, skill: what must run for the target, in order.  The steps of one plan are numbered in one task."""
    wanted = closure(deps, target).select(F.col("needs").alias("skill")).unionByName(skills.where(F.col("skill") == target).select("skill")).distinct()
    placed = levels(skills, deps).join(wanted, "skill", "left_semi")
    return placed.select(F.row_number().over(Window.partitionBy().orderBy("level", "skill")).alias("step"), "skill")


def violations(skills: DataFrame, deps: DataFrame) -> DataFrame:
    """skill, problem: no endpoint, a need that is not there, a cycle."""
    no_endpoint = skills.where("endpoint = ''").select("skill", F.lit("missing endpoint").alias("problem"))
    dangling = deps.join(skills.select(F.col("skill").alias("dep")), "dep", "left_anti").select("skill", F.concat(F.lit("unknown dependency "), F.col("dep")).alias("problem"))
    cyclic = levels(skills, deps).where("level is null").select("skill", F.lit("cycle").alias("problem"))
    return no_endpoint.unionByName(dangling).unionByName(cyclic)


def recent_turns(turns: DataFrame, k: int = 3) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_r", newest).where(F.col("_r") <= k).drop("_r")


def to_summarise(turns: DataFrame, keep: int = 3, beyond: int = 6) -> DataFrame:
    """All but the newest turns of conversations that have grown too long."""
    by = Window.partitionBy("conv_id")
    rows = turns.withColumns({"_r": F.row_number().over(by.orderBy(F.desc("turn"))), "_n": F.count(F.lit(1)).over(by)})
    return rows.where((F.col("_n") > beyond) & (F.col("_r") > keep)).drop("_r", "_n")


def recalled(turns: DataFrame, keyword: str) -> DataFrame:
    return turns.where(F.contains(F.lower("text"), F.lit(keyword.lower())))


def memory_context(turns: DataFrame, entries: int = 5, lines: int = 3) -> DataFrame:
    """conv_id, context: the first lines of the newest entries, oldest first."""
    top = F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n")
    rows = recent_turns(turns, entries).select("conv_id", F.struct("turn", top.alias("t")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("context"))


#: Labels of the decisions (fixed values).
DECISIONS = {"standard": "표준체 인수", "substandard": "조건부 인수 (할증/부담보)", "decline": "인수 거절", "refer": "전문 심사 회부"}


def underwritten(cases: DataFrame) -> DataFrame:
    """customer_id, decision, n_risks, n_warnings, total_after.

    cases: customer_id, age, occupation_grade, active_policies, total_existing, requested, diseases array<struct<status, severity>>.  Diseases are judged in order: a later active one overrules.
    """

    def disease(d: Column, x: Column) -> Column:
        chronic = x["status"] == "chronic"
        return (
            F.when(chronic & (x["severity"] == "severe"), "decline")
            .when(chronic & (x["severity"] == "moderate") & (d == "standard"), "substandard")
            .when(x["status"] == "active", "refer")
            .otherwise(d)
        )

    by_disease = F.aggregate("diseases", F.lit("standard"), disease)
    by_work = F.when((F.col("occupation_grade") >= 4) & (F.col("d0") == "standard"), "substandard").otherwise(F.col("d0"))
    after = F.col("total_existing") + F.coalesce("requested", F.lit(0.0))
    by_sum = F.when((F.col("total_after") > 500_000_000) & F.col("d1").isin("standard", "substandard"), "refer").otherwise(F.col("d1"))
    yes = lambda c: c.cast("int")
    ill = F.size(F.filter("diseases", lambda x: x["status"].isin("chronic", "active")))
    warned = F.size(F.filter("diseases", lambda x: (x["status"] == "active") | ((x["status"] == "chronic") & x["severity"].isin("severe", "moderate"))))
    risks = ill + yes(F.col("occupation_grade") >= 3) + yes(F.col("age") >= 55)
    warnings = warned + yes(F.col("occupation_grade") >= 4) + yes(F.col("age") >= 65) + yes(F.col("total_after") > 300_000_000) + yes(F.col("active_policies") >= 5)
    rows = cases.withColumn("d0", by_disease).withColumn("d1", by_work).withColumn("total_after", after).withColumn("decision", by_sum)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), F.col("decision"))
    return rows.select("customer_id", "decision", label.alias("label"), risks.alias("n_risks"), warnings.alias("n_warnings"), "total_after")
