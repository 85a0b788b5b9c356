"""Plans, execution logs, listings and the policy reader on small inputs, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import service
from quarry.sources import readers


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def plain_order(plan):
    """(skill, needs) in an order where all that is needed comes first; as given if there is a cycle."""
    names, level = {s for s, _ in plan}, {}
    while True:
        ready = [(s, 1 + max((level[d] for d in needs if d in names), default=-1)) for s, needs in plan if s not in level and all(d in level for d in needs if d in names)]
        if not ready:
            break
        level |= dict(ready)
    return [s for s, _ in plan] if len(level) < len(plan) else [s for _, _, s in sorted((level[s], i, s) for i, (s, _) in enumerate(plan))]


def test_ordered_plans(spark):
    rng = random.Random(5)
    plans = {}
    for run in range(40):
        names = [f"s{i}" for i in rng.sample(range(9), rng.randint(1, 7))]
        plans[run] = [(s, rng.sample([f"s{i}" for i in range(9)], rng.randint(0, 2))) for s in names]
    items = spark.createDataFrame([(r, i, s, d) for r, p in plans.items() for i, (s, d) in enumerate(p)], "run long, pos int, skill string, depends_on array<string>")
    registry = spark.createDataFrame([(f"s{i}", "GET", f"/e{i}") for i in range(9)], "skill string, method string, endpoint string")
    got: dict = {}
    for run, _, skill, _, endpoint in rows(service.ordered_plans(items, registry), "run", "step"):
        assert endpoint == "/e" + skill[1:]
        got.setdefault(run, []).append(skill)
    assert got == {r: plain_order(p) for r, p in plans.items()}
    known = registry.where("skill <> 's1'")
    assert service.ordered_plans(items, known).where("skill = 's1'").count() == 0
    assert service.ordered_plans(items.limit(0), registry).count() == 0


def test_plan_without_needs(spark):
    items = spark.createDataFrame([(1, 0, "b", None), (1, 1, "a", [])], "run long, pos int, skill string, depends_on array<string>")
    registry = spark.createDataFrame([("a", "GET", ""), ("b", "GET", "")], "skill string, method string, endpoint string")
    assert [r[2] for r in rows(service.ordered_plans(items, registry), "step")] == ["b", "a"]


def test_execution_log_and_summary(spark):
    tries = spark.createDataFrame(
        [(1, 0, "a", 1, True, "보", "가나", None), (1, 1, "b", 1, False, "x", None, "e1"), (1, 1, "b", 2, True, "x", None, None), (1, 2, "c", 1, False, None, None, "e1"), (1, 2, "c", 2, False, None, None, "e2"), (1, 2, "c", 3, False, None, None, None), (1, 2, "c", 4, True, None, "late", None)],
        "run int, step int, skill string, attempt int, ok boolean, input string, output string, error string",
    )
    log = service.execution_log(tries)
    got = rows(log.select("step", "status", "attempts", "waited", "input_bytes", "output_bytes", "output", "error"), "step")
    assert got == [(0, "success", 1, 0.0, 3, 6, "가나", None), (1, "success", 2, 1.0, 1, 0, None, None), (2, "error", 3, 3.0, 0, 0, None, None)]
    (summary,) = service.execution_summary(log).collect()
    assert summary["summary"].split("\n") == ["[OK] Step 0: a (attempts=1, in=3B, out=6B)", "  Output: 가나", "[OK] Step 1: b (attempts=2, in=1B, out=0B)", "[FAIL] Step 2: c (attempts=3, in=0B, out=0B)", "  Error: unknown error"]
    assert summary["failures"] == "- 스킬 'c' (Step 2) 실패: 알 수 없는 오류"
    assert service.execution_log(tries.limit(0)).count() == 0


def test_figures_of_nothing(spark):
    docs = spark.createDataFrame([], "path string, n_entities int, n_relationships int, error string, text string, status string")
    assert rows(service.build_stats(docs), "item") == [("total", "entities", 0), ("total", "processed", 0), ("total", "relationships", 0)]
    assert rows(service.storage_totals(docs), "n_files") == [(0, 0.0)]
    assert rows(service.upload_summary(docs), "total") == [(0, 0, 0)]
    nulls = spark.createDataFrame([(None,), ("saved",), ("ingested",), ("failed",)], "status string")
    assert rows(service.upload_summary(nulls), "total") == [(4, 2, 2)]


def test_admitted(spark):
    requests = spark.createDataFrame([(1, "u", None, "core"), (2, "u", "http://a", "uw"), (3, "u", "http://b", "uw"), (4, "x", None, "core"), (5, "u", None, "other"), (6, None, None, None)], "id int, user_id string, url string, system string")
    servers = spark.createDataFrame([("http://a",), ("http://a",), (None,)], "url string")
    users = spark.createDataFrame([("u",), ("u",)], "user_id string")
    assert rows(service.admitted(requests, servers, users).select("id"), "id") == [(1,), (2,)]


def test_stale_and_listing(spark):
    tasks = spark.createDataFrame([(1, "completed", "2024-01-01 00:00:00"), (2, "failed", "2024-01-02 00:00:00"), (3, "running", "2024-01-01 00:00:00"), (4, "completed", None)], "id int, status string, completed_at string")
    assert rows(service.stale(tasks, F.lit("2024-01-02 00:00:01").cast("timestamp")).select("id"), "id") == [(1,)]
    docs = spark.createDataFrame([(p, "o", "r", "d", "") for p in ("/assets/x.md", "/b/y.md", "/a/z.md", None)], "path string, owner string, allowed_role string, allowed_department string, effective_date string")
    assert [r[0] for r in rows(service.permission_listing(docs.where("path is not null")), "path")] == ["/a/z.md", "/b/y.md"]
    assert rows(docs.where("path is not null").select("path", service.workspace_of(F.col("path"), "a")), "path") == [("/a/z.md", True), ("/assets/x.md", False), ("/b/y.md", False)]


@pytest.mark.parametrize("text, counts", [("", (0, 0, 0)), ("roles: {r: {allowed_paths: {read: ['/a/**'], write: []}}, s: }\nusers: [{user_id: u, roles: [r, s], department: d}, {user_id: v}]\ndepartments: {d: {name: Dee}, e: null}\n", (2, 1, 2))])
def test_policy(spark, tmp_path, text, counts):
    (tmp_path / "iam.yaml").write_text(text, encoding="utf-8")
    users, globs, departments = readers.policy(spark, str(tmp_path / "iam.yaml"))
    assert (users.count(), globs.count(), departments.count()) == counts
    if text:
        named = service.with_department(users, departments)
        assert rows(named.select("user_id", "role", "department_name"), "role") == [("u", "r", "Dee"), ("u", "s", "Dee")]
