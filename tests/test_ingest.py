"""Conversion chains, trees, streamed calls and contexts against plain versions."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quarry.operators import contexts, ingestion, trees
from quarry.streaming import calls, flows


def test_chain_of_converters(spark):
    seen = []

    def package(content, path):
        if not path.endswith(".docx"):
            raise ValueError("no package")
        return content.decode()

    def layer(files):
        seen.append(sorted(r.path for r in files.collect()))
        return files.withColumns({"text": F.col("content").cast("string"), "error": F.lit(None).cast("string")})

    files = spark.createDataFrame([("/a.docx", b"# hello"), ("/b.docx", b"  "), ("/c.pdf", b"x" * 200), ("/d.pdf", b"12"), ("/e.md", None)], "path string, content binary")
    steps = [("package", ingestion.called(package), ingestion.not_blank), ("layer", layer, ingestion.enough_letters)]
    rows = {r.path: (r.step, r.text, [tuple(e) for e in r.errors]) for r in ingestion.converted(files, steps).collect()}
    none = ("package", "ValueError: no package")
    assert rows == {
        "/a.docx": ("package", "# hello", []),
        "/b.docx": (None, None, [("package", "not usable"), ("layer", "not usable")]),
        "/c.pdf": ("layer", "x" * 200, [none]),
        "/d.pdf": (None, None, [none, ("layer", "not usable")]),
        "/e.md": (None, None, [none, ("layer", "not usable")]),
    }
    assert seen == [["/b.docx", "/c.pdf", "/d.pdf", "/e.md"]]  # the second step sees what the first left
    assert {r.step: r.n for r in ingestion.step_counts(ingestion.converted(files, steps)).collect()} == {"package": 1, "layer": 1, None: 3}
    assert ingestion.converted(files, []).where("step is null").count() == 5


def test_ingest_files(spark, tmp_path):
    plain = lambda files: files.withColumns({"text": F.col("body"), "error": F.lit(None).cast("string")})
    rows = [("/in/a.md", "---\nowner: x\n---\n\n\n#  t\n\n\n\n\nbody"), ("/in/b.docx", "고객 번호 1"), ("/in/c.exe", "x"), ("/in/d.pdf", None), ("/in/e.pdf", "내규")]
    files = spark.createDataFrame(rows, "path string, body string")
    told = ingestion.ingest_files(files, [("plain", plain, ingestion.not_blank)], "u1", str(tmp_path / "docs"))
    assert {r.path: r.error for r in told.collect()} == {"Shared/a.md": None, "Shared/b.md": None, "Shared/e.md": None, "/in/c.exe": "unsupported format exe", "/in/d.pdf": "plain: not usable"}
    stored = {r.path: r for r in spark.read.parquet(str(tmp_path / "docs")).collect()}
    assert {p: r.grade for p, r in stored.items()} == {"Shared/a.md": 1, "Shared/b.md": 3, "Shared/e.md": 2}
    assert "owner" not in stored["Shared/a.md"].text and stored["Shared/a.md"].text.endswith("body\n") and "\n\n\n" not in stored["Shared/a.md"].text
    assert stored["Shared/b.md"].meta["source_format"] == ".docx" and stored["Shared/b.md"].meta["rag_allowed"] == "false" and stored["Shared/b.md"].meta["owner"] == "u1"


def image(src, alt="old"):
    return {"t": "Image", "c": [["", [], []], [{"t": "Str", "c": alt}], [src, ""]]}


def test_replaced_images(spark):
    tree = {"blocks": [{"t": "Para", "c": [image("a.png"), {"t": "Div", "c": [[image("b.png"), image("c.png")]]}]}, {"t": "Image", "c": "odd"}]}
    want = {"blocks": [{"t": "Para", "c": [{"t": "RawBlock", "c": ["markdown", "|표|"]}, {"t": "Div", "c": [[image("b.png", "a cat"), image("c.png")]]}]}, {"t": "Image", "c": "odd"}]}
    found = {"a.png": ("table", "|표|"), "b.png": ("diagram", "a cat"), "z.png": ("text", "x")}
    assert trees.with_replacements(tree, found) == want
    df = spark.createDataFrame([(json.dumps(tree), found), ("no json", found), (None, found), (json.dumps(tree), {}), (json.dumps(tree), None)], "tree string, found map<string,struct<kind:string,content:string>>")
    got = [r.t for r in df.select(trees.replaced_images(F.col("tree"), F.col("found")).alias("t")).collect()]
    assert json.loads(got[0]) == want and got[1:3] == ["no json", None] and got[3] == got[4] == json.dumps(tree)


def test_tool_calls_in_batches(spark, tmp_path):
    rng = random.Random(8)
    schema = "call string, idx int, ord long, id string, name string, arguments string"
    rows = [(f"c{c}", i, k, f"id{c}{i}" if k == 0 else rng.choice([None, ""]), "tool" if k == 0 else None, rng.choice(["{", "}", "x", None])) for c in range(4) for i in range(2) for k in range(6)]
    rng.shuffle(rows)  # fragments come late and in any order
    folder = str(tmp_path / "in")
    for a in range(0, len(rows), 16):
        spark.createDataFrame(rows[a : a + 16], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r.call, r.idx): (r.id, r.name, r.arguments, r.n) for r in flows.drained(calls.tool_calls(stream), "update", ["call", "idx"]).collect()}
    want = {(f"c{c}", i): (f"id{c}{i}", "tool", "".join(r[5] or "" for r in sorted(r for r in rows if r[:2] == (f"c{c}", i)) if True), 6) for c in range(4) for i in range(2)}
    assert got == want
    made = spark.createDataFrame([("a", "tool", "{}"), ("b", "tool", ""), ("c", "tool", "{"), ("d", "none", "{}")], "call string, name string, arguments string")
    assert {r.call: r.fine for r in calls.read_arguments(made, ["tool"]).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_continued_answers(spark):
    rows = [("a", 0, "one ", "length"), ("a", 1, "two", "stop"), ("b", 0, "x", "stop"), ("b", 1, "never", "stop"), ("c", 0, "", "length"), ("d", 0, "p", "length"), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "call string, round int, text string, finish string")
    assert {r.call: (r.text, r.n_rounds, r.cut) for r in calls.continued_answers(df).collect()} == {"a": ("one two", 2, False), "b": ("x", 1, False), "c": ("", 1, True), "d": ("p", 2, False)}


def test_search_context(spark):
    entities = spark.createDataFrame(
        [("p1", "Plan One", "product", 5, {"description": "a plan", "product_code": "X1", "source_document": "doc"}, "ns"), ("o1", "Org", "org", 9, {}, ""), ("s1", "Secret", "org", 1, None, None)],
        "id string, name string, entity_type string, mentions long, properties map<string,string>, namespace string",
    )
    edges = spark.createDataFrame([("p1", "o1", "by"), ("o1", "s1", "knows")], "src string, dst string, relation_type string")
    sources = spark.createDataFrame([("p1", "/Public/a"), ("s1", "/Private/b")], "id string, source_path string")
    members = spark.createDataFrame([("c1", "p1"), ("c2", "o1")], "community string, id string")
    communities = spark.createDataFrame([("c1", "Plans", ""), ("c2", "Orgs", "all")], "community string, name string, summary string")
    may_read = F.startswith("source_path", F.lit("/Public/"))
    near = spark.createDataFrame([(1, "/Public/a.md", " text ", 0.5), (2, "/Public/b.md", "more", 0.25)], "doc_id long, path string, text string, score double")
    graph = (
        "=== 관련 엔티티 ===\n- [product] Plan One: a plan (상품코드=X1) [범위: ns] [출처: doc]\n- [org] Org\n\n"
        "=== 관계 ===\n- Plan One --[by]--> Org\n- Org --[knows]--> Secret\n\n=== 커뮤니티 요약 ===\n- Plans: (요약 없음)"
    )
    given = (entities, edges, members, communities, sources, may_read)
    assert contexts.search_context("plan one", *given, fuzzy=0).first().context == "[검색 쿼리: plan one]\n\n" + graph
    vector = "=== 검색 결과 (벡터 검색) ===\n[1] /Public/a.md (score=0.500)\ntext\n\n[2] /Public/b.md (score=0.250)\nmore\n\n"
    assert contexts.search_context("plan one", *given, near=near, fuzzy=0).first().context == "[검색 쿼리: plan one]\n\n" + vector + graph
    assert contexts.search_context("nothing", *given, fuzzy=0).first().context == "[검색 쿼리: nothing]"


def test_skill_entities(spark):
    rows = [(f"e{i}", f"Europe {i}", "region", g, {"description": f"d{i}"}) for i, g in enumerate([1, 3, None, 2, 1, 1, 1])]
    entities = spark.createDataFrame(rows, "id string, name string, entity_type string, security_grade int, properties map<string,string>")
    sources = spark.createDataFrame([("e0", "/Public/x/a@1.md"), ("e2", "/Private/b.md"), ("e3", "/Public/c.md"), ("e3", "/Private/d.md")], "id string, source_path string")
    given = (entities, sources, F.startswith("source_path", F.lit("/Public/")))
    got = [(r.name, r.type, r.security_grade, r.sources, r.description) for r in contexts.skill_entities("Europe", *given, n=3).orderBy("ord").collect()]
    assert got[:3] == [("Europe 0", "region", 1, "a", "d0"), ("Europe 3", "region", 2, "c", "d3"), ("Europe 4", "region", 1, "", "d4")]
    assert got[3][:3] == ("[접근 제한 2건]", "notice", None) and got[3][4].startswith("권한이 없는 문서에서 2건의")
    every = [r.name for r in contexts.skill_entities("Europe", *given, admin=True, n=3).orderBy("ord").collect()]
    assert every == ["Europe 0", "Europe 1", "Europe 2"]
