"""Operators on small tables."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import acl, audit, documents, fuzzy, graph, retrieval, workflow
from quarry.sources import readers


def test_globs(spark):
    paths = spark.createDataFrame([("/Public/a.md",), ("/Public/x/b.md",), ("/Private/u/c.md",), ("/P1/q.md",)], "p string")
    got = lambda globs: [r.p for r in paths.where(acl.glob_match(F.col("p"), globs)).collect()]
    assert got(["/Public/**"]) == ["/Public/a.md", "/Public/x/b.md"]
    assert got(["/P?/*"]) == ["/P1/q.md"]
    assert got(["*/[ab].md"]) == ["/Public/a.md", "/Public/x/b.md"]
    assert got([]) == []


@pytest.mark.parametrize(
    "user, roles, dept, path, mode, want",
    [
        ("a", ["admin"], "it", "/Shared/underwriting/x.md", "read", "ok"),
        ("u", ["viewer"], "it", "/Shared/underwriting/x.md", "read", "no_permission"),
        ("u", ["viewer"], "it", "Shared/it/x.md", "write", "ok"),
        ("u", ["viewer"], "it", "/Private/u/x.md", "write", "ok"),
        ("u", ["viewer"], "it", "/Private/v/x.md", "read", "private"),
        ("u", ["viewer"], "it", "/Shared/other/x.md", "read", "ok"),
        ("u", ["viewer"], "it", "/Public/x.md", "write", "no_permission"),
    ],
)
def test_decisions(spark, user, roles, dept, path, mode, want):
    who = acl.Principal(user, roles, dept, {"read": ["/Public/**", "/Shared/**"]}, ["it", "underwriting"])
    assert spark.createDataFrame([(path,)], "p string").select(who.decision(F.col("p"), mode).alias("d")).first().d == want


def test_upserts(spark):
    events = spark.createDataFrame([("a", "A1", "t", 1, "p1", "k", "v1"), ("a", "A2", "t", 2, "p2", "k", "v2"), ("a", "A3", "t", 3, "p1", "m", "")], "id string, name string, entity_type string, ord long, source_path string, prop_key string, prop_value string")
    row = graph.upsert_entities(events).first()
    assert (row["name"], row["mentions"], row["source_paths"], row["properties"]) == ("A1", 3, ["p1", "p2"], {"k": "v1"})
    edges = spark.createDataFrame([("a", "b", "x", 2, "p", 1.0), ("a", "b", "y", 1, "q", 2.0)], "src string, dst string, relation_type string, ord long, source_path string, weight double")
    assert tuple(graph.upsert_edges(edges).first()) == ("a", "b", "y", "q", 3.0)
    assert graph.upsert_edges(edges, by_relation=True).count() == 2


def test_traversal_and_components(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "s"), ("x", "y", "r")], "src string, dst string, relation_type string")
    hops = lambda *a: {r.id: r.hops for r in graph.neighbours(edges, *a).collect()}
    assert hops("a", 2) == {"b": 1, "c": 2}
    assert hops("d", 3, ["r"]) == {}
    assert {r.id: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_louvain_parts_two_cliques():
    links = [(a, b, 1.0) for q in (0, 4) for a in range(q, q + 4) for b in range(a + 1, q + 4)] + [(0, 4, 1.0)]
    got = graph.louvain(8, links)
    assert len(set(got[:4])) == 1 and len(set(got[4:])) == 1 and got[0] != got[4]
    assert graph.louvain(3, []) == [0, 1, 2]


def test_similarity():
    assert fuzzy.weighted_similarity("", "a") == 0 and fuzzy.weighted_similarity("abc", "abc") == 100
    assert fuzzy.weighted_similarity("new york mets", "mets york new") == pytest.approx(95.0)
    assert fuzzy.weighted_similarity("yankees", "new york yankees") == pytest.approx(90.0)


def test_versions(spark):
    rows = spark.createDataFrame([("n", "2024-01-01", 1), ("n", "2024-05-01", 2), ("n", "2025-01-01", 3), ("m", None, 4), ("m", None, 5)], "name string, effective_date string, rank long")
    assert {(r["name"], r["rank"]) for r in graph.newest_versions(rows, "2024-06-01").collect()} == {("n", 2), ("m", 4)}
    log = spark.createDataFrame([("p", "aaaa1", 1, "x"), ("p", "bbbb2", 2, "y")], "path string, commit_hash string, ts long, content string")
    assert documents.at_commit(log, "p", "aaaa").first()["content"] == "x"
    assert documents.at_commit(log, "p", "zz").count() == 0
    assert documents.current(documents.rolled_back(log, "p", "aaaa", 9)).first()["commit_hash"] == "rollback"


def test_workflow(spark):
    skills = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", ""), ("p", "x"), ("q", "x")], "skill string, endpoint string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "none"), ("p", "q"), ("q", "p")], "skill string, dep string")
    assert {r.skill: r.level for r in workflow.levels(skills, deps).collect()} == {"a": 0, "b": 1, "c": 2, "p": None, "q": None}
    assert [(r.step, r.skill) for r in workflow.execution_plan(skills, deps, "c").orderBy("step").collect()][:3] == [(1, "a"), (2, "b"), (3, "c")]
    assert {tuple(r) for r in workflow.violations(skills, deps).collect()} == {("c", "missing endpoint"), ("c", "unknown dependency none"), ("p", "cycle"), ("q", "cycle")}


@pytest.mark.parametrize(
    "diseases, grade, existing, want",
    [([], 1, 0.0, "standard"), ([("chronic", "severe")], 1, 0.0, "decline"), ([("chronic", "severe"), ("active", "mild")], 1, 0.0, "refer"), ([("chronic", "moderate")], 1, 6e8, "refer"), ([], 4, 0.0, "substandard"), ([("chronic", "severe")], 1, 6e8, "decline")],
)
def test_underwriting(spark, diseases, grade, existing, want):
    row = spark.createDataFrame([(1, 30, grade, 0, existing, None, diseases)], "customer_id long, age int, occupation_grade int, active_policies int, total_existing double, requested double, diseases array<struct<status: string, severity: string>>")
    assert workflow.underwritten(row).first()["decision"] == want


def test_empty_tables(spark):
    log = spark.createDataFrame([], "id long, user_id string, skill_name string, status string, output_payload string, reasoning string, started_at timestamp_ntz, duration_s double")
    assert tuple(audit.status_counts(log).first()) == (0, 0, 0, 0, 0.0)
    assert audit.skill_usage(log).count() == 0 and audit.usage(log).count() == 0


def test_hybrid_prefers_words_among_equals(spark):
    rows = spark.createDataFrame([(1, "nothing", [1.0, 0.0]), (2, "has apple", [1.0, 0.0]), (3, "far", [0.0, 1.0])], "doc_id long, text string, embedding array<float>")
    got = retrieval.hybrid_search(rows, [1.0, 0.0], "Apple", F.lit(True), k=2).collect()
    assert [r.doc_id for r in got] == [2, 1] and got[0].score == 1.0


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_packages(spark):
    book = _zip(**{"xl/workbook.xml": "<workbook><sheets><sheet name='S'/></sheets></workbook>", "xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1'><v>2</v></c></row><row><c r='B2'><v>3</v></c></row></sheetData></worksheet>"})
    files = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.xlsx", bytearray(b"junk"))], "path string, content binary")
    rows = {r.path: r for r in readers.packages(files, "xlsx").collect()}
    assert rows["a.xlsx"].markdown == "| h | 2 |\n| --- | --- |\n|  | 3 |" and rows["b.xlsx"].error == "BadZipFile"
    deck = _zip(**{"ppt/slides/slide10.xml": "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:t>ten</a:t></a:p></p:sld>", "ppt/slides/slide2.xml": "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:t>two</a:t></a:p></p:sld>"})
    assert [s[:2] for s in readers.slide_texts(deck)] == [(2, "two"), (10, "ten")]
    hwpx = _zip(**{"Contents/section0.xml": "<s><p><t>para</t></p><p><tbl><tc><cellAddr rowAddr='0' colAddr='1'/><cellSpan rowSpan='2' colSpan='1'/><p><t>c</t></p></tc></tbl></p></s>"})
    assert readers.hwpx_elements(hwpx) == [("paragraph", 0, 0, 1, 1, "para"), ("cell", 0, 1, 2, 1, "c")]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "Public").mkdir()
    (tmp_path / "Skills").mkdir()
    (tmp_path / "Public/a.md").write_text("---\nowner: x\ntags: [1]\n---\nbody")
    (tmp_path / "Public/b.md").write_text("---\n: [\n---\nrest")
    (tmp_path / "Skills/c.md").write_text("hidden")
    rows = {r.path: r for r in readers.with_front_matter(readers.markdown_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"Public/a.md", "Public/b.md"}
    assert rows["Public/a.md"].meta["owner"] == "x" and rows["Public/a.md"].body == "body" and rows["Public/b.md"].meta == {}


def test_roles_of_any_glob(spark):
    docs = spark.createDataFrame([(1, "/Public/z/a.md"), (2, "/Private/x.md"), (3, "/Pubs/b.md")], "doc_id long, path string")
    globs = spark.createDataFrame([("admin", "read", "/**"), ("a", "read", "/Pub*"), ("b", "read", "/Public/*/a.md"), ("c", "write", "/**"), ("d", "read", "/Private/[xy].md")], "role string, mode string, pattern string")
    got = {r.doc_id: r.roles for r in acl.derived_roles(docs, globs).collect()}
    assert got == {1: "a,admin,b", 2: "admin,d", 3: "a,admin"}
    assert acl.derived_roles(docs, globs.where("false")).count() == 0


def test_streams_of_several_batches(spark, tmp_path):
    from quarry.streaming import edge_store, flows

    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    put = lambda rows: spark.createDataFrame(rows, "src string, dst string, relation_type string, ord long, source_path string, weight double").coalesce(1).write.mode("append").parquet(folder)
    put([("x", "y", "r", 1, "a", 1.0), ("x", "z", "r", 2, "a", 1.0)])
    put([("x", "y", "q", 3, "b", 1.0)])
    stream = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    weights = lambda df: {(r.src, r.dst): (r.relation_type, r.weight) for r in df.collect()}
    assert weights(edge_store.incremental_edges(stream(), store)) == {("x", "y"): ("r", 2.0), ("x", "z"): ("r", 1.0)}
    put([("x", "y", "q", 4, "b", 1.0), ("n", "m", "r", 5, "b", 1.0)])
    assert weights(edge_store.incremental_edges(stream(), store)) == {("x", "y"): ("r", 3.0), ("x", "z"): ("r", 1.0), ("n", "m"): ("r", 1.0)}
    turns = str(tmp_path / "turns")
    for a in range(3):
        spark.range(3 * a, 3 * a + 3).selectExpr("1L AS conv_id", "id AS turn").coalesce(1).write.mode("append").parquet(turns)
    source = spark.readStream.schema("conv_id long, turn long").option("maxFilesPerTrigger", 1).parquet(turns)
    assert [tuple(r) for r in flows.drained(flows.compacted_sessions(source), "update", ["conv_id"]).collect()] == [(1, 9, 3, 6)]


def test_edges_of_any_weight_by_batches(spark, tmp_path):
    """Batches folded one by one are the upsert of all rows; only buckets that a batch touches are written; a batch run again changes nothing."""
    import random

    from quarry.streaming import edge_store

    rng, store = random.Random(3), str(tmp_path / "store")
    schema = "src string, dst string, relation_type string, source_path string, ord long, weight double, properties map<string,string>"
    row = lambda k: (f"a{rng.randrange(9)}", f"b{rng.randrange(9)}", rng.choice("rq"), f"p{k % 3}", rng.randrange(10**6) * 100 + k, float(rng.randint(1, 9)), {"k": str(k)})
    batches = [[row(k + 20 * b) for k in range(20)] for b in range(4)] + [[("x", "y", "r", "p", 7, 5.0, {"k": "0"})], [("x", "y", "r", "p", 3, 5.0, {"k": "1"})], []]
    told = lambda df: {(r.src, r.dst): (r.relation_type, r.source_path, r.weight, tuple(r.properties.items())) for r in df.collect()}
    for number, rows in enumerate(batches):
        for _ in range(2 if number in (0, 3) else 1):
            edge_store.fold_batch(spark.createDataFrame(rows, schema), store, number, buckets=8)
        every = spark.createDataFrame([r for b in batches[: number + 1] for r in b], schema)
        assert told(edge_store.edge_table(spark, store)) == told(graph.upsert_edges(every))
    assert told(edge_store.edge_table(spark, store))["x", "y"] == ("r", "p", 6.0, (("k", "1"),))
    assert len(list((tmp_path / "store/data/v5").glob("bucket=*"))) == 1 and not (tmp_path / "store/data/v6").exists()
    assert sorted(p.name for p in (tmp_path / "store/manifests").glob("m*")) == ["m5", "m6"]
    # a manifest without its mark is not there
    (tmp_path / "store/manifests/m6/_SUCCESS").unlink()
    assert told(edge_store.edge_table(spark, store))["x", "y"][2] == 6.0


def test_traversed_edges(spark):
    edges = spark.createDataFrame([("a", "b", "r", {"w": "1"}), ("b", "a", "q", {"w": "2"}), ("c", "b", "r", {}), ("c", "d", "q", {}), ("a", "a", "r", {}), ("x", "y", "r", {})], "src string, dst string, relation_type string, properties map<string,string>")
    nodes, met = graph.traversed(edges, "a", 2)
    assert {tuple(r) for r in nodes.collect()} == {("b", 1), ("c", 2)}
    assert {(r.src, r.dst, r.hop, r.properties.get("w")) for r in met.collect()} == {("a", "b", 1, "1"), ("b", "a", 1, "2"), ("a", "a", 1, None), ("c", "b", 2, None)}
    nodes, met = graph.traversed(edges, "a", 3, ["r"])
    assert {r.id for r in nodes.collect()} == {"b", "c"} and met.count() == 3
    assert [df.count() for df in graph.traversed(edges, "nowhere", 2)] == [0, 0] and [df.count() for df in graph.traversed(edges, "a", 0)] == [0, 0]


def test_user_code_has_its_time(spark):
    from quarry.functions import skills

    skills.register(spark, "twice", "def run(x):\n    return x * 2")
    assert [r.y for r in spark.range(3).selectExpr("twice(id) AS y").collect()] == ["0", "2", "4"]
    skills.register(spark, "forever", "def run(x):\n    while True:\n        pass", seconds=0.5)
    with pytest.raises(Exception, match="more than 0.5 s"):
        spark.range(1).selectExpr("forever(id) AS y").collect()


def test_user_code_stays_inside(spark):
    from quarry.functions import skills

    for code in (
        "def run(): return ().__class__.__base__.__subclasses__()", "import random\ndef run(): return random._os.getpid()", "import json\ndef run(): return json.codecs.sys.path",
        "def run(x): return '{0.__class__}'.format(x)", "from random import _os\ndef run(): return 1", "def run(): return __builtins__", "from json.codecs import sys\ndef run(): return 1",
    ):
        with pytest.raises(ValueError):
            skills.register(spark, "escape", code)
    assert skills.problems("def run(x):\n    return '{} {x.real}'.format(x, x=x) + str(x.real)") == []

    def told(source, *values, seconds=5.0):
        child = skills.Child(source, seconds)
        try:
            return child.call(values)
        finally:
            child.close()

    assert told("def run(a, b):\n    print('noise')\n    return {'s': [a, b]}", 1, None) == {"s": [1, None]}
    assert "HOME" not in told("import random\ndef run(): return dict(random._os.environ)")  # were it not refused, it would see nothing
    with pytest.raises(ValueError, match="OSError|Error"):
        told("import random\ndef run():\n    fd = random._os.open('f', 65)\n    return random._os.write(fd, b'x')")
    with pytest.raises((ValueError, RuntimeError)):
        told("def run(): return len([0] * (1 << 28))")
    with pytest.raises(ValueError, match="NameError"):
        skills.Child("x = open", 5.0)
    with pytest.raises(TimeoutError):
        told("def run():\n    try:\n        while True: pass\n    except BaseException:\n        pass", seconds=0.3)
    skills.register(spark, "joined", "def run(xs, n):\n    return ','.join(xs) * n if xs else None")
    assert [r.y for r in spark.sql("SELECT joined(array('a', 'b'), 2) AS y UNION ALL SELECT joined(null, 1)").collect()] == ["a,ba,b", None]


def test_findings(spark):
    from quarry.functions import security

    df = spark.createDataFrame([(1, "tel 010-1234-5678, a@b.co; 900101-1234567"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.f for r in df.select("id", security.pii_findings(F.col("text")).alias("f")).collect()}
    assert [(x.kind, x.start) for x in got[1]][:2] == [("phone", 4), ("email", 19)] and not got[2] and not got[3]
    masked = security.masked_response(df, skip=("id",)).orderBy("id").first().text
    assert masked.startswith("tel ***-****-****, ***@***.***") and "010" not in masked and "900101" not in masked


def test_places_of_findings(spark):
    from quarry.functions import security

    rng = random.Random(8)
    texts = ["".join(rng.choice(["010-1234-5678", "01012345678", "a@b.co ", "x", " ", "가", "12-34-567890-12"]) for _ in range(n)) for n in (0, 1, 2, 3, 5, 17, 300)] + ["010-1234-5678 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in df.select("id", security.pii_findings(F.col("text")).alias("f")).collect():
        want = sorted((m.start(), m.end() - m.start(), kind) for kind, (pattern, _) in security.PII.items() for m in re.finditer(pattern, texts[r.id]))
        assert [tuple(x)[:3] for x in r.f] == want


def test_snapshots_of_graphs(spark, tmp_path):
    from quarry.sources import sinks, tables

    table = lambda n: spark.range(n).withColumn("of", F.lit(n))
    folder = str(tmp_path / "graph")
    with pytest.raises(ValueError):
        sinks.read_graph(spark, folder)
    for n in range(1, 5):
        sinks.write_graph(table(n), table(n + 1), folder)
        assert [df.count() for df in sinks.read_graph(spark, folder)] == [n, n + 1]
    (tmp_path / "graph" / "heads" / "9").mkdir()  # a head that was not written to its end
    assert [df.count() for df in sinks.read_graph(spark, folder)] == [4, 5]
    assert tables.whole_tables(spark, folder + "/heads") == ["2", "3"] and len(list((tmp_path / "graph" / "data").iterdir())) == 2


def test_newest_days(spark, tmp_path):
    from quarry.sources import sinks

    folder = str(tmp_path / "days")
    sinks.append_provenance(spark.createDataFrame([(k, f"2024-01-{k:02d}") for k in range(1, 13)] + [(99, None)], "id long, day string"), folder)
    got = sinks.read_provenance(spark, folder, "id long")
    assert sorted(r.id for r in got.collect()) == list(range(6, 13)) and len({f.split("/")[-2] for f in got.inputFiles()}) == 13
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in sinks.read_provenance(spark, folder, "id long", day="2024-01-03").collect()] == [3]


def test_closure_of_cycles_and_chains(spark):
    deps = [(f"s{i}", f"s{i + 1}") for i in range(9)] + [("p", "q"), ("q", "p"), ("p", "s8")]
    df = spark.createDataFrame(deps, "skill string, dep string")
    want = set(deps)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert {tuple(r) for r in workflow.closure(df).collect()} == want
    assert {tuple(r) for r in workflow.closure(df, "q").collect()} == {(a, b) for a, b in want if a == "q"} | {x for x in want if x[0] == "q"}
    skills = spark.createDataFrame([(s, "x") for s in ["a", "a", None]], "skill string, endpoint string")
    assert [tuple(r) for r in workflow.levels(skills, df.where("false")).collect()] == [("a", 0)]
    assert workflow.levels(skills.where("false"), df).count() == 0
