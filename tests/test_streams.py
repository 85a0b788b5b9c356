"""Kill switches over several micro-batches, graph builds that break off, go on and retry."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import extract
from quarry.streaming import graph_build, switch

EVENT = "switch string, ts timestamp, ord long, activate boolean, reason string, seconds int"


def appended(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def plain_changes(events, history):
    out, on, kept = [], {}, {}

    def note(name, at, event, reason):
        kept[name] = min(kept.get(name, 0) + 1, history)
        out.append((name, at, event, reason, kept[name]))

    for name, at, _, activate, reason, seconds in sorted(events, key=lambda e: (e[1], e[2])):
        if name in on and on[name][0] is not None and on[name][0] <= at:
            until, why = on.pop(name)
            note(name, until, "timed out", why)
        if activate:
            on[name] = (None if seconds is None else at + seconds, reason)
            note(name, at, "activated", reason)
        elif name in on:
            del on[name]
            note(name, at, "deactivated", reason)
    newest = max(e[1] for e in events)
    for name, (until, why) in on.items():
        if until is not None and until <= newest:
            note(name, until, "timed out", why)
    return out, {n: r for n, (u, r) in on.items() if u is None or u > newest}


@pytest.mark.parametrize("history", [1000, 3])
def test_switches(spark, tmp_path, history):
    rng = random.Random(history)
    events, at = [], 1_700_000_000
    for k in range(90):
        at += rng.choice([0, 1, 5, 40])
        events.append((rng.choice("abc"), at, k, rng.random() < 0.6, f"r{k}", rng.choice([None, 3, 30, 100])))
    events.append(("late", events[-1][1] - 0, 99, True, None, 0))  # ends at once
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    as_rows = lambda part: [(n, t, o, a, r, s) for n, t, o, a, r, s in part]
    put = lambda part: spark.createDataFrame(as_rows(part), EVENT.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(folder)
    for a, b in ((0, 20), (20, 45)):
        put(events[a:b])
    switch.changes_table(stream(spark, folder), state, history)
    for a, b in ((45, 70), (70, len(events))):  # a later run goes on
        put(events[a:b])
    changes = switch.changes_table(stream(spark, folder), state, history)
    got = [(r.switch, int(r.s), r.event, r.reason, r.n_kept) for r in changes.withColumn("s", F.unix_seconds("at")).collect()]
    want, on = plain_changes(events, history)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.switch: r.reason for r in switch.active_switches(changes).collect()} == on
    assert switch.recent_history(changes, 2).groupBy("switch").count().agg(F.max("count")).first()[0] == 2
    jobs = spark.createDataFrame([(n,) for n in [*"abc", "free", None]], "key string")
    assert {r.key for r in switch.guarded(jobs, changes, "key").collect()} == {*"abc", "free", None} - set(on)


DOC = "doc_id long, path string, text string"


def documents(n, start=0):
    words = ["alpha", "beta", "gamma", "nothing"]
    return [(k, f"/Public/d{k}.md", " ".join(words[(k + j) % 4] for j in range(k % 3 + 1))) for k in range(start, start + n)]


def flaky(always=(), until=None):
    def run(docs):
        told = extract.dictionary_answers(docs, dict.fromkeys(("alpha", "beta", "gamma"), "term"))
        fails = F.col("doc_id").isin(*always) if always else F.lit(False)
        for k, n in (until or {}).items():
            fails = fails | ((F.col("doc_id") == k) & (F.col("round") < n))
        return told.withColumn("error", F.when(fails, "bad"))

    return run


def graph_of(spark, store):
    nodes, edges = graph_build.built_graph(spark, store)
    told = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    return told(nodes.withColumn("source_paths", F.array_sort("source_paths")), "id", "name", "entity_type", "mentions", "source_paths"), told(edges, "src", "dst", "relation_type", "weight", "source_path")


def test_a_broken_build_goes_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        appended(spark, folder, documents(5, 5 * k), DOC)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    run = flaky(always=[4], until={6: 1, 7: 2})
    graph_build.build_graph(stream(spark, folder), run, whole)
    calls = []

    def breaks(docs):
        calls.append(1)
        if len(calls) == 2 or len(calls) == 4:
            raise RuntimeError("executor lost")
        return run(docs)

    for _ in range(2):  # in the second batch, then in the first round of retries
        with pytest.raises(Exception, match="executor lost"):
            graph_build.build_graph(stream(spark, folder), breaks, broken)
    graph_build.build_graph(stream(spark, folder), breaks, broken)
    assert graph_of(spark, broken) == graph_of(spark, whole)
    progress = lambda store: {tuple(r) for r in graph_build.build_progress(spark, store).collect()}
    assert progress(broken) == progress(whole) == {(0, 12, 0), (1, 1, 0), (2, 1, 1)}
    before = len(calls)
    graph_build.build_graph(stream(spark, folder), breaks, broken)  # nothing is new: nothing is extracted
    assert len(calls) == before and graph_of(spark, broken) == graph_of(spark, whole)
    # new files: they alone are extracted, and tried again where they fail
    appended(spark, folder, documents(4, 15), DOC)
    graph_build.build_graph(stream(spark, folder), flaky(until={16: 1}), broken)
    assert progress(broken) == {(0, 15, 0), (1, 2, 0), (2, 1, 1)}
    assert {r.doc_id for r in graph_build.build_status(spark, broken).where("error is not null").collect()} == {4}


def test_called_answers(spark):
    def call(text, seconds):
        if text == "boom":
            raise ValueError("no")
        return "not json" if text == "odd" else json.dumps({"entities": [{"name": text, "type": "term"}], "relationships": [{"source": text, "target": "X"}]}) if seconds >= 600 else "{}"

    docs = spark.createDataFrame([(1, "/a.md", "one"), (2, "/b.md", "boom"), (3, "/c.md", "odd"), (4, "/d.md", None)], DOC).withColumn("budget_s", graph_build.budget(F.col("text"), F.col("path")))
    rows = {r.doc_id: (r.error, [e.name for e in r.answer.entities] if r.answer and r.answer.entities else None) for r in graph_build.called_answers(docs, call).collect()}
    assert rows == {1: (None, ["one"]), 2: ("ValueError: no", None), 3: ("no JSON", None), 4: (None, [""])}
    big = spark.createDataFrame([("x" * 16384, "/사업방법서1.md"), ("x" * 16384, "/a.md"), (None, "/a.md")], "text string, path string")
    assert [r.b for r in big.select(graph_build.budget(F.col("text"), F.col("path"), 2).alias("b")).collect()] == [7200, 2400, 1200]


class _Counted:
    """A value, a list and the timers of a switch, counting what is written."""

    def __init__(self):
        self.held, self.timers, self.writes = None, set(), 0

    def getValueState(self, *_):  # noqa: N802
        return _Counted()

    getListState = getValueState  # noqa: N815

    def exists(self):
        return self.held is not None

    def get(self):
        return [] if self.held is None else self.held

    def update(self, value):
        self.held, self.writes = value, self.writes + 1

    put = update

    def clear(self):
        self.held = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_switch_writes_its_state_once_a_batch():
    one, handle = switch.Switch(3), _Counted()
    one.init(handle)
    rows = lambda first: pd.DataFrame({"at_ms": [first + i * 1000 for i in range(50)], "ord": range(50), "activate": [i % 2 == 0 or i > 40 for i in range(50)], "reason": "r", "seconds": [9.0 if i % 3 else None for i in range(50)]})
    (out,) = one.handleInputRows(("s",), iter([rows(0)]), None)
    assert one.history.writes == 1 and one.count.writes == 1 and one.state.writes == 1
    assert out["nth"].tolist() == list(range(1, 51)) and out["n_kept"].tolist() == [1, 2, *[3] * 48]
    assert handle.timers == {49_000 + 9_000} and one.state.get() == (58_000, "r")
    (out,) = one.handleInputRows(("s",), iter([rows(100_000)]), None)
    assert out["event"].tolist()[:2] == ["timed out", "activated"] and out["nth"].tolist()[0] == 51 and handle.timers == {158_000}
