"""Audits on small fixed inputs, with the edges of each ladder."""

from stratalode.operators import audit, offsets, rollups
from stratalode.sources import tree


def project(spark):
    rows = [
        ("README.md", "hi"), ("pyproject.toml", 'version = "1"'), ("tests/test_a.py", "x = 1\n"), (".github/workflows/ci.yml", "a: 1"),
        ("pkg/a.py", 'p = "C:\\\\Users\\\\bob\\\\x"\n# C:\\Users\\bob\n"""\nC:\\Users\\bob\n"""\n' + "\n" * 9 + 'q = Path("D:\\\\data")\nif q.exists():\n    pass\n# FIXME\n'),
    ]
    return tree.from_table(spark.createDataFrame(rows, "rel string, content string"), "rel", "content")


def test_health_and_readiness(spark):
    f = project(spark)
    got = {r.name: r.found for r in audit.health(f).collect()}
    assert got["README"] == "README.md" and got["LICENSE"] is None and got["Requirements"] == "pyproject.toml" and got["CI Config"] == ".github/workflows" and got["Tests"] == "tests"
    assert tuple(audit.health_score(audit.health(f)).first()) == (60, 6, 10)
    ready = {r.name: r.passed for r in audit.readiness(f, offsets.lines(f, "rel", "content")).collect()}
    assert ready["Version defined"] and not ready["No critical markers"] and ready["Few prints"] and not ready["License exists"]


def test_paths(spark):
    f = project(spark)
    assert [(r.line, r.rule_id) for r in audit.hardcoded_paths(offsets.lines(f, "rel", "content")).collect()] == [(1, "PORT-001")]


def test_reports(spark):
    r = spark.createDataFrame([('{"dependencies": [{"name": "A_b", "version": "1.0", "vulns": [{"id": "X", "aliases": ["CVE-1"]}, {"id": "Y", "aliases": []}]}]}',)], "report string")
    assert sorted((x.package, x.id, x.severity) for x in audit.vulnerabilities(r).collect()) == [("a-b", "X", "HIGH"), ("a-b", "Y", "MEDIUM")]
    have = spark.createDataFrame([("a", "1.10"), ("b", "2"), ("c", "1.2rc1")], "package string, version string")
    want = spark.createDataFrame([("a", "1.9"), ("b", "2.0.1"), ("c", "1.2")], "package string, version string")
    assert [x.package for x in audit.outdated(have, want).collect()] == ["b"]
    runs = spark.createDataFrame([(1, "1 failed\nx\n== 3 passed, 2 failed in 1s ==\n")], "run int, output string")
    assert tuple(audit.test_runs(runs).first()) == (1, 3, 2, 0)


def test_design(spark):
    m = spark.createDataFrame([("orphan_ui", 6.0), ("orphan_backend", 10.0), ("health", 49.0), ("cycles", 0.0)], "name string, value double")
    got = audit.design_review(m).collect()
    assert sorted(x.name for x in got) == ["health", "orphan_ui"] and {x.advice for x in got} == {"refactor first"}


def test_ladders(spark):
    f = lambda rows: spark.createDataFrame(rows, "rule_id string, severity string, dir string, rel string")
    assert tuple(rollups.severity_counts(f([("A", "ODD", "d", "x")])).first()) == (1, 0, 0, 0)
    cards = {r.dir: (r.grade, r.score) for r in rollups.module_cards(f([("A", "LOW", "d", str(i)) for i in range(4)] + [("A", "HIGH", "e", "x")]), "dir", "rel").collect()}
    assert cards["d"] == ("D", 75) and cards["e"] == ("F", 5)
    assert rollups.review(f([])).first().decision == "GO" and rollups.review(f([("SEC-1", "LOW", "d", "x")])).first().decision == "NO-GO"
    edge = spark.createDataFrame([("MEDIUM",)] * 49, "severity string")
    assert {r.batch: r.tasks for r in rollups.batch_totals(edge).collect()} == {"now": 48, "next": 1, "later": 0, "backlog": 0}
