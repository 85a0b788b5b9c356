"""Control logic, user code, equations, extraction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.functions import equations, skills
from quarry.operators import control, extract, graph


def test_kill_switch():
    now = [0.0]
    switch = control.KillSwitch(lambda: now[0])
    switch.guard()
    switch.activate("drill", seconds=5)
    with pytest.raises(RuntimeError, match="drill"):
        switch.guard()
    now[0] = 6.0
    assert not switch.active and [e[0] for e in switch.history] == ["activated", "deactivated"]
    for _ in range(2000):
        switch.activate("x")
    assert len(switch.history) == 1000
    switch.deactivate()
    switch.deactivate()
    assert switch.history[-2][0] == "activated"


def test_code(spark):
    assert skills.problems("import os.path\nx = eval('1')\ny.getattr(z)") == ["module: os.path", "call: eval", "call: getattr"]
    assert skills.problems("def (") and not skills.problems("import math")
    skills.register(spark, "compound", "import math\ndef run(a, n):\n    return math.floor(a * 1.1 ** n)", "int")
    assert spark.sql("SELECT compound(100.0D, 2) AS r").first()["r"] == 121
    with pytest.raises(ValueError):
        skills.register(spark, "bad", "import socket\ndef run(): return 1")
    kinds = skills.parameters({"a": {"type": "number", "required": True}, "b": {"type": "integer"}})
    assert kinds["a"].dataType.simpleString() == "double" and not kinds["a"].nullable and kinds["b"].nullable


@pytest.mark.parametrize(
    "script, parts",
    [
        ("a over b", ["<m:f><m:num>", "<m:den>"]),
        ("x^{2}_i", ["<m:sSubSup>"]),
        ("SUM from {i=1} to n x", ['m:val="∑"', "<m:sub>"]),
        ("LEFT ( alpha RIGHT )", ['<m:begChr m:val="("/>', "α"]),
        ("cases{a ## b}", ["<m:eqArr><m:e>"]),
        ("sqrt{bar x} times \"if\"", ["<m:rad>", "<m:acc>", "×", "if"]),
        ("x^", ["<m:t>x^</m:t>"]),
        ("a < b", ["&lt;"]),
        ("", ["<m:oMath></m:oMath>"]),
    ],
)
def test_equations(script, parts):
    made = equations.omml(script)
    assert all(p in made for p in parts), made


def test_extraction(spark):
    answer = "struct<" + extract.ANSWER.replace("entities ", "entities:", 1).replace(", relationships ", ", relationships:", 1) + ">"
    row = ([("Death Cover", "Coverage", "d", {"coverage_amount": "1", "secret": "x", "severity": ""}), ("  ", "x", "", {}), ("Plan", None, None, None)], [("death cover", "Plan", "part_of", ""), ("Plan", "Unknown Thing", None, ""), ("", "Plan", "x", "")])
    docs = spark.createDataFrame([(1, "Public/Plan_약관_2504.md", "<!-- page:3 --> 제2조", row)], f"doc_id long, path string, text string, answer {answer}")
    entities = extract.raw_entities(docs)
    got = {r["id"]: r for r in entities.collect()}
    assert set(got) == {"plan::death_cover", "plan"}
    assert got["plan::death_cover"]["properties"] == {"coverage_amount": "1", "description": "d", "source_document": "Plan_약관_2504", "page_start": "3", "page_end": "3", "section_ref": "제2조"}
    assert {(r.src, r.dst, r.relation_type) for r in extract.raw_edges(docs, entities).collect()} == {("plan::death_cover", "plan", "part_of"), ("plan", "unknown_thing", "references")}
    assert graph.upsert_edges(extract.raw_edges(docs, entities)).count() == 2


def test_layers_and_responses(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int")
    assert {tuple(r) for r in control.layered([a, a.where("k = 'x'").withColumn("v", F.lit(2))], "k").collect()} == {("x", 2), ("y", 1)}
    rows = spark.createDataFrame([(200, '{"header": {"resultCode": "0000"}}'), (500, '{"header": {"resultCode": "0000"}}'), (200, "x"), (200, "{}")], "s int, b string")
    made = control.response_result(F.col("s"), F.col("b"))
    assert [tuple(r) for r in rows.select(made["success"], made["error_code"]).collect()] == [(True, None), (False, "0000"), (False, None), (False, "E999")]
