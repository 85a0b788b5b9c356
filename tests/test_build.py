"""Graph builds around extraction on hand-written rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import build


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_files(spark):
    paths = ["/a/x.md", "Skills/x.md", "/a/assets/x.md", "/a/iam.yaml", "/README.md", "/a/README.md.md", "/a/.x.md", "a/b/x.md", None]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in rows(build.graph_files(files), "path")] == ["/a/.x.md", "/a/README.md.md", "/a/x.md", "a/b/x.md"]
    assert [r[0] for r in rows(build.build_files(files, "/a/"), "path")] == ["/a/README.md.md", "/a/assets/x.md", "/a/iam.yaml", "/a/x.md"]
    assert build.build_files(files).count() == 7


@pytest.mark.parametrize("text, want", [
    ("가" * 49, (True, False, "가" * 49)), ("가" * 50, (False, False, "가" * 50)), ("가" * 50 + "a" * 51, (False, True, "가" * 50 + "a" * 51)),
    ("  abcde \n", (True, False, "")), (" abcdef ", (True, False, "abcdef")), ("", (True, False, "")), (None, (True, False, "")),
])
def test_conversion_quality(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in build.conversion_quality(F.col("t")).items()])
    assert tuple(df.first()) == want


@pytest.mark.parametrize("found, want", [(("|a|", "t", "c"), ("table", "|a|")), (("", "t", "c"), ("text", "t")), ((None, "", "c"), ("diagram", "c")), ((None, None, None), ("diagram", ""))])
def test_image_result(spark, found, want):
    df = spark.createDataFrame([found], "a string, b string, c string")
    assert tuple(df.select(build.image_result(F.col("a"), F.col("b"), F.col("c")).alias("r")).first()["r"]) == want


IMAGE, FACT = "path string, kind string, caption string, table_md string", "path string, key string, value string, context string"


def test_asset_graph(spark):
    images = [("/assets/doc/t.png", "table", "cap", "|a|"), ("/assets/doc/i.png", "diagram", "", None), ("n.png", "table", "c" * 300, ""), (None, "table", "x", "|a|")]
    facts = [("/assets/doc/t.png", "two words", "1", None), ("/assets/doc/t.png", "two words", "1", None), ("/assets/doc/i.png", "no table", "1", "x"), (None, "k", "1", "x"), ("/assets/doc/t.png", None, "1", "x")]
    nodes, edges = build.asset_graph(spark.createDataFrame(images, IMAGE), spark.createDataFrame(facts, FACT))
    assert rows(nodes.select("id", "name", "entity_type", "source_path"), "id") == [
        ("fact_t_two_words", "two words", "fact", "/assets/doc/t.png"),
        ("img_i", "i", "image", "/assets/doc/i.png"),
        ("img_n", "c" * 80, "image", "/assets//n.png"),
        ("tbl_t", "표: doc", "table", "/assets/doc/t.png"),
    ]
    props = {r.id: r.properties for r in nodes.collect()}
    assert props["fact_t_two_words"] == {"value": "1", "context": "", "parent_table": "tbl_t", "parent_document": "doc"}
    assert props["tbl_t"]["raw_markdown"] == "|a|" and len(props["img_n"]["caption"]) == 200
    assert rows(edges.select("src", "relation_type", "dst"), "src", "relation_type") == [("img_i", "belongs_to", "doc"), ("tbl_t", "belongs_to", "doc"), ("tbl_t", "contains", "fact_t_two_words")]


def test_asset_graph_of_nothing(spark):
    nodes, edges = build.asset_graph(spark.createDataFrame([], IMAGE), spark.createDataFrame([], FACT))
    assert nodes.count() == edges.count() == 0


def test_historical_entities(spark):
    versions = spark.createDataFrame([("p", f"{i:08d}ff", i, "2024-01-01", " m " if i else None) for i in range(13)] + [("q", "aaaa", 1, "d", "")], "path string, commit_hash string, ts long, day string, message string")
    extracted = versions.select("path", "commit_hash", F.col("ts").cast("string").alias("id"), F.lit("n").alias("name"), F.when(F.col("ts") > 5, F.create_map(F.lit("version_hash"), F.lit("old"), F.lit("k"), F.lit("v"))).alias("properties"))
    got = build.historical_entities(extracted, versions)
    assert sorted(int(r.id) for r in got.collect()) == list(range(2, 12))  # neither the current one nor more than ten
    one = got.where("id = '7'").first()
    assert one.source_path == "p@00000007"
    assert one.properties == {"k": "v", "version_hash": "00000007", "version_date": "2024-01-01", "version_label": "2024-01-01 (00000007)", "is_historical": "true", "version_message": "m"}


def test_plans_from_replies(spark):
    replies = spark.createDataFrame([(1, '{"skills": [{"name": "b"}, {"name": "a"}, {"name": "b"}, {"name": "?"}, {}]}'), (2, "broken"), (3, None), (4, "{}"), (5, '{"skills": [{"name": "c"}]}')], "run long, reply string")
    registry = spark.createDataFrame([("a", None, "GET", "e"), ("b", ["a"], "POST", "e"), ("c", ["b"], "POST", "e")], "skill string, depends_on array<string>, method string, endpoint string")
    assert rows(build.plans_from_replies(replies, registry).select("run", "step", "skill"), "run", "step") == [(1, 0, "a"), (1, 1, "b"), (5, 0, "c")]


def test_removals(spark):
    index = spark.createDataFrame([("a",), ("a",), ("b",)], "source_path string")
    paths = spark.createDataFrame([("a",), ("a",), ("z",)], "source_path string")
    assert rows(build.removal_counts(index, paths), "source_path") == [("a", 2), ("z", 0)]
    assert rows(build.without_chunks(index, paths), "source_path") == [("b",)]


def test_history_of_a_thread(spark):
    rows_in = [("t", 2, [("user", "b"), (None, "c")]), ("t", 1, []), ("u", 3, None), ("t", 3, None)]
    got = build.thread_history(spark.createDataFrame(rows_in, "thread_id string, checkpoint_id int, messages array<struct<role: string, content: string>>"), "t").collect()
    assert [r.checkpoint_id for r in got] == [1, 2, 3]
    assert [tuple(m) for m in got[1].messages] == [("user", "b"), ("unknown", "c")] and got[2].messages is None
