"""Distributed communities against the plain Louvain of one task."""

from __future__ import annotations

import random

import pytest

from quarry.operators import community, graph
from quarry.plans.views import spark_view

SF = "/root/testdata/sf0.001"


def plain(edges):
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    place = {x: i for i, x in enumerate(ids)}
    best: dict = {}
    for a, b, w in edges:
        pair = (min(place[a], place[b]), max(place[a], place[b]))
        best[pair] = max(best.get(pair, 0.0), w)
    found = graph.louvain(len(ids), [(a, b, w) for (a, b), w in sorted(best.items())])
    return plain_modularity(best, found), ids, found


def plain_modularity(best, found):
    total = 2 * sum(best.values())
    degree = [0.0] * len(found)
    for (a, b), w in best.items():
        degree[a] += w
        degree[b] += w
    mass: dict = {}
    for i, c in enumerate(found):
        mass[c] = mass.get(c, 0.0) + degree[i]
    return 2 * sum(w for (a, b), w in best.items() if found[a] == found[b]) / total - sum((m / total) ** 2 for m in mass.values())


def partition_graph(rng, groups, size, inside, outside):
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    return [(f"n{a[0]}-{a[1]}", f"n{b[0]}-{b[1]}", float(rng.randint(1, 3))) for k, a in enumerate(nodes) for b in nodes[:k] if rng.random() < (inside if a[0] == b[0] else outside)]


@pytest.mark.parametrize("inside, outside", [(0.5, 0.01), (0.3, 0.04)])
def test_louvain_on_groups(spark, inside, outside):
    edges = partition_graph(random.Random(7), 8, 20, inside, outside) + [("n0-1", "n0-1", 2.0), ("n0-3", "n0-2", 1.0)]
    want, _, _ = plain(edges)
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    members = community.louvain_communities(df)
    rows = {r.id: r.community for r in members.collect()}
    assert set(rows) == {x for a, b, _ in edges for x in (a, b)}
    assert all(rows[c] == c and c <= i for i, c in rows.items())
    assert community.modularity(df, members) >= 0.98 * want


def test_louvain_on_a_given_table(spark):
    df = spark_view(spark, SF, "v_tree_edges").selectExpr("src", "dst", "1.0D AS weight").unionByName(
        spark_view(spark, SF, "v_edge_events").where("relation_type = 'R'").groupBy("src", "dst").count().selectExpr("src", "dst", "CAST(count AS DOUBLE) AS weight")
    )
    want, ids, found = plain([tuple(r) for r in df.collect()])
    as_found = spark.createDataFrame(list(zip(ids, map(str, found))), "id string, community string")
    assert community.modularity(df, as_found) == pytest.approx(want)
    assert community.modularity(df, community.louvain_communities(df)) >= 0.98 * want


def test_odd_graphs(spark):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert community.louvain_communities(empty).count() == 0 and community.modularity(empty, empty.selectExpr("src AS id", "dst AS community")) == 0
    pair = spark.createDataFrame([("b", "a", 1.0), ("a", "b", 3.0), ("c", "c", 1.0), ("e", "d", 0.0)], "src string, dst string, weight double")
    assert {r.id: r.community for r in community.louvain_communities(pair).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
