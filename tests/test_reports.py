"""Reports, and the matcher's tests of names and call order."""

import json

from pyspark.sql import functions as F

from stratalode.operators import detectors, matching, reports, rollups


def rules(text, rel="a.py", lang="python"):
    return {(r[1], r[3]) for r in matching.scan_text(rel, lang, text, matching.RULES)}


def test_calls_are_read_level_by_level():
    assert ("PY-008", 1) in rules("x = g(b.c(1)), open(name)\n")
    assert ("PY-008", 1) not in rules("x = b.c(open(name))\n")
    assert ("PY-008", 1) not in rules("x = open(name, mode='rb')\n")


def test_environment_in_tests():
    text = "import os\nx = os.environ['A']\n"
    assert ("PY-007", 2) in rules(text, "tests/conftest.py") and ("PY-007", 2) in rules(text, "tests/a.py")
    assert ("PY-007", 2) not in rules(text, "pkg/test_a.py")


def test_storage_in_pages():
    text = "const f = x => {\n  localStorage.setItem('a', 1)\n}\n"
    assert ("QUAL-010", 2) in rules(text, "a.js", "javascript") and ("QUAL-010", 2) not in rules(text, "test-a.js", "javascript")
    assert ("QUAL-010", 4) not in rules("try {\n const f = x => {\n }\n  localStorage.setItem('a', 1)\n} catch (e) {}\n", "a.js", "javascript")


def test_matched_text_is_whole(spark):
    long = f"password = \"{'a' * 400}\"\n"
    found = [r for r in matching.scan_text("a.py", "python", long, matching.RULES) if len(r[6]) > 200]
    assert found
    df = spark.createDataFrame([("a.py", "SEC-008", "MEDIUM", 1, long)], "rel string, rule_id string, severity string, line long, matched_text string")
    out = json.loads(reports.json_report(df, 1, 63, spark.createDataFrame([(False, 10)], "passed boolean, score long")))
    assert len(out["findings"][0]["matched_text"]) == 200 and out["summary"]["medium"] == 1 and out["quality_gate"] == {"passed": False, "score": 10}


def test_exit_code(spark):
    counts = spark.createDataFrame([(30, 0, 30, 0)], "total long, high long, medium long, low long")
    gate = rollups.gate(rollups.quality_score(counts, F.lit(10)))
    assert reports.exit_code(gate) == 2 and reports.exit_code(None) == 0 and reports.exit_code(rollups.gate(rollups.quality_score(counts, F.lit(10)), 0, 30, 0)) == 0


def test_debt_in_other_languages(spark):
    rows = [(1, "// TODO x"), (2, "# tech-debt"), (3, "a # type: ignore"), (4, "plain"), (5, "fixme and TODO # later")]
    got = {r.line: (r.marker, r.note) for r in detectors.debt(spark.createDataFrame(rows, "line long, text string").withColumn("rel", F.lit("f")), "rel").collect()}
    assert got == {1: ("TODO", "// TODO x"), 2: ("TECH-DEBT", "tech-debt"), 5: ("FIXME", "later")}


def test_components_and_tests(spark):
    lines = spark.createDataFrame([("a.js", 1, "class Menu extends X"), ("a.js", 2, "<side-bar id='top'/>"), ("b.js", 1, "function Menu() {}")], "rel string, line long, text string")
    wanted = spark.createDataFrame([("Menu",), ("side-bar",), ("top",), ("Gone",)], "name string")
    got = {r.name: (r.rel, r.line, r.severity) for r in reports.contract_components(lines, wanted).collect()}
    assert got == {"Menu": ("a.js", 1, None), "side-bar": ("a.js", 2, None), "top": ("a.js", 2, None), "Gone": (None, None, "MEDIUM")}
    f, t = spark.createDataFrame([("load",), ("save",)], "name string"), spark.createDataFrame([("tests/test_load.py",), ("tests/b.py",)], "rel string")
    got = reports.has_test(f, t)
    assert {r.name: r.has_test for r in got.collect()} == {"load": True, "save": False}
    assert tuple(reports.stub_coverage(got).first()) == (2, 1, 1, 50.0)


def test_answers(spark, tmp_path):
    df = spark.createDataFrame([(1, "```json\n{\"a\": 1}\n``` done"), (2, " [1, 2] "), (3, "no json"), (4, "```\nbad\n```")], "i long, t string")
    assert {r.i: r.j for r in df.select("i", reports.json_of(F.col("t")).alias("j")).collect()} == {1: '{"a": 1}', 2: "[1, 2]", 3: None, 4: None}
    for name, text in (("a.json", '{"entries": [{"rule_id": "R", "line": 3, "useful": true}]}'), ("b.json", "{bad"), ("c.json", "[]"), ("d.json", '{"entries": 5}')):
        (tmp_path / name).write_text(text)
    assert [(r.rule_id, r.line, r.useful) for r in reports.read_feedback(spark, str(tmp_path)).collect()] == [("R", 3, True)]
    score = reports.answer_score(F.lit(True), F.lit(True), F.lit(False), F.lit(False), F.lit("hard"))
    assert spark.range(1).select(score.alias("s")).first().s == 180.0


def test_summaries(spark):
    smells = spark.createDataFrame([("f", i, "HIGH" if i < 3 else "LOW") for i in range(10)], "rel string, line long, severity string")
    assert {r.severity: r.n for r in reports.first_by_severity(smells, ["rel", "line"], 5).collect()} == {"HIGH": 3, "LOW": 2}
    assert tuple(reports.advisory_summary(smells).first()) == (10, 0, 3, 0, 7)
    assert reports.by_type(smells, "severity").count() == 2
    assert reports.audit_text(spark.createDataFrame([("p", 1, 2, 3)], "project string, high long, medium long, low long")).first().report == "p: 1 high, 2 medium, 3 low"
