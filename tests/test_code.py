"""Fixtures of source files: each has a known set of findings and facts."""

from stratalode.engine import Engine
from stratalode.operators import code, filters, matching, offsets, relational
from stratalode.operators.fixers import fix_text
from stratalode.operators.matching import scan_text
from stratalode.operators.rules import RULES
from stratalode.sources import documents, tree
from stratalode.streaming import changes


def found(text, lang="python", rel="pkg/a.py", **options):
    return sorted({r[1] for r in scan_text(rel, lang, text, RULES, **options)})


def test_rules_and_positions():
    rows = scan_text("a.py", "python", "x = 1\n  y = pickle.loads(z)\n", RULES)
    assert [(r[1], r[3], r[4]) for r in rows] == [("SEC-009", 2, 7)]
    assert len(RULES) == 63 and sum(r[1] == "HIGH" for r in RULES) == 20


def test_strings_and_comments():
    assert "SEC-007" not in found("# eval(user_input)\n")
    assert "SEC-007" in found("v = eval(data)\n")
    assert "QUAL-007" in found("# TODO: later\n") and "QUAL-007" not in found('x = "TODO later"\n')


def test_syntax_validators():
    assert "PY-001" in found("def f(a) -> None:\n    return 1\n") and "PY-001" not in found("def f(a) -> None:\n    return\n")
    assert "PY-006" in found("def f():\n    global x\n") and "PY-006" not in found("global x\n")
    assert "PY-007" in found('a = os.environ["X"]\n')
    assert "PY-007" not in found('os.environ["X"] = 1\n') and "PY-007" not in found('try:\n    a = os.environ["X"]\nexcept KeyError:\n    pass\n')
    assert "PY-007" in found('try:\n    a = os.environ["X"]\nexcept (OSError, ValueError):\n    pass\n')
    assert "PY-008" in found("f = open(name)\n") and "PY-008" not in found('f = open(name, "rb")\n') and "PY-008" not in found("f = Image.open(name)\n")
    assert "QUAL-003" in found("n = int(request.x)\n") and "QUAL-003" not in found("try:\n    n = int(request.x)\nexcept ValueError:\n    n = 0\n")
    assert "QUAL-004" in found("n = float(params.x)\n") and "QUAL-004" not in found("n = float(args.x)\n")
    assert "PY-005" in found("d = json.loads(s)\n") and "PY-005" not in found("# x\ntry:\n    d = json.loads(s) # nosec\nexcept ValueError:\n    pass\n")


def test_context_validators_and_taint():
    assert "SEC-002" in found("a.innerHTML = '<b>' + name;\n", "javascript") and "SEC-002" not in found("sanitize(name);\na.innerHTML = '<b>' + name;\n", "javascript")
    assert "SEC-004" in found('query.execute(f"select {t}")\n') and "SEC-004" not in found('for t in ("a", "b"):\n    query.execute(f"select {t}")\n')
    assert "SEC-004" not in found('cur.execute("select %s", (path,))\n')
    assert "SEC-005" in found("urlopen(base + query)\n") and "SEC-005" not in found('urlopen("http://localhost" + query)\n')
    assert "QUAL-010" in found('localStorage.setItem("a", 1)\n', "javascript") and "QUAL-010" not in found('try {\nlocalStorage.setItem("a", 1)\n} catch (e) {}\n', "javascript")
    plain = 'cur.execute(f"select {t}")\n'
    assert "SEC-004" not in found(plain, taint="lite") and "SEC-004" in found(plain, taint="strict") and "SEC-004" in found(plain, taint="off")
    hits = {m: [r[13] for r in scan_text("a.py", "python", plain, RULES, taint=m) if r[1] == "SEC-004"] for m in ("strict", "off")}
    assert hits == {"strict": [False], "off": [None]}


def test_policy_and_suppression(spark):
    text = "subprocess.run(x, shell=True)\n"
    assert "SEC-003" in found(text) and "SEC-003" not in found(text, rel="tests/test_a.py") and "SEC-003" in found(text, rel="tests/test_a.py", policy="strict")
    for mark in ("y = eval(x)  # lint: ignore[SEC-007]", "# lint: ignore-next[SEC-007]\ny = eval(x)", "y = eval(x)\n# lint: ignore-file[SEC-007]", "# lint: ignore-start[SEC-007]\ny = eval(x)"):
        assert "SEC-007" not in found(mark + "\n")
        df = spark.createDataFrame([("a.py", mark)], "rel string, content string")
        spans = filters.suppressions(offsets.lines(df, "rel", "content"))
        at = mark.split("\n").index(next(x for x in mark.split("\n") if x.startswith("y ="))) + 1
        left = filters.unsuppressed(spark.createDataFrame([("a.py", "SEC-007", at)], "rel string, rule_id string, line long"), spans)
        assert left.count() == 0
    ended = "# lint: ignore-start[SEC-007]\n# lint: ignore-end[SEC-007]\ny = eval(x)\n"
    assert "SEC-007" in found(ended)


def test_fixers_clear_their_rule():
    for rule, text, line in [
        ("QUAL-001", "try:\n    x()\nexcept:\n    pass\n", 3), ("PY-007", "import os\na = os.environ['X']\n", 2), ("QUAL-003", "n = int(query.x)\n", 1), ("QUAL-004", "n = float(params.x)\n", 1),
        ("SEC-003", "import subprocess\nsubprocess.run(c, shell=True)\n", 2), ("SEC-009", "import yaml\nd = yaml.load(f)\n", 2), ("PY-005", "import json\nd = json.loads(s)\n", 2),
    ]:
        assert rule in found(text), rule
        new, done, _ = fix_text(text, [(rule, line)])
        assert done == 1 and rule not in found(new), rule


def test_tree_and_facts(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "_private").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.py").write_text("a = 1\n")
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "_private" / "x.py").write_text("import os\nimport sys\n\ndef used():\n    return os\n\ndef long_name():\n    a = 7\n    b = 7\n    c = 9\n    return used()\n")
    (tmp_path / "big.py").write_text("#" * ((1 << 20) + 1))
    e = Engine(spark, str(tmp_path))
    assert sorted(r.rel for r in e.files().select("rel").collect()) == ["_private/x.py", "pkg/__init__.py"]
    assert [r.bound for r in e.unused_imports().collect()] == ["sys"]
    assert [r.name for r in e.dead_functions().collect()] == ["long_name"]
    assert [(r.src, r.dst) for r in code.call_edges(e.fact("functions"), e.fact("calls")).collect()] == [("_private/x.py::long_name", "_private/x.py::used")]
    assert e.smells().where("smell = 'magic_number'").count() == 3
    assert e.scan().count() == matching.scan(e.files().repartition(3)).count()


def test_wiring(spark):
    files = spark.createDataFrame(
        [("app.py", '@app.route("/api/users")\n@app.route("/api/lost/<id>")\n'), ("index.html", "fetch('/api/users?x=1')\nfetch('/api/users/')\nfetch('/api/ghost')\n")], "rel string, content string"
    )
    files = tree.from_table(files, "rel", "content")
    got = {r.route: (r.status, r.cardinality) for r in relational.wiring(code.ui_calls(files), code.server_routes(files), "route").collect()}
    assert got["/api/users"] == ("wired", "many:1") and got["/api/ghost"][0] == "orphan_ui" and got["/api/lost/_PARAM_"][0] == "orphan_backend"


def test_sources(tmp_path, spark):
    (tmp_path / "b.json").write_text('{"findings": [{"rule_id": "A", "file": "x.py", "line": 3}]}')
    assert [tuple(r) for r in documents.baseline(spark, str(tmp_path / "b.json")).collect()] == [("A", "x.py", 3)]
    assert documents.baseline(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "pyproject.toml").write_text('[tool.lint]\nseverity = "high"\nexclude = ["a"]\npolicy-profile = "odd"\n')
    c = documents.project_config(str(tmp_path), "lint", exclude=["b"])
    assert (c.severity, c.exclude, c.policy) == ("HIGH", ("a", "b"), "balanced")
    assert documents.parse_log("\0\na.py\na.py\nb.py\n\0\nc.py\n") == [(0, "a.py"), (0, "b.py"), (1, "c.py")]


def test_changes(spark):
    s = "rel string, mtime double, digest string"
    a = spark.createDataFrame([("kept", 1.0, "x"), ("touched", 1.0, "x"), ("new_text", 1.0, "x"), ("gone", 1.0, "x")], s)
    b = spark.createDataFrame([("kept", 1.0, "x"), ("touched", 2.0, "x"), ("new_text", 2.0, "y"), ("made", 2.0, "x")], s)
    assert sorted(tuple(r) for r in changes.between(a, b).collect()) == [("gone", "deleted"), ("made", "created"), ("new_text", "modified")]


def test_watch(spark, tmp_path):
    """Polls as files of a directory stream: create, change, touch without change, delete."""
    import json

    polls = tmp_path / "polls"
    polls.mkdir()
    seen = {}
    listings = spark.readStream.schema(changes.LISTING).option("maxFilesPerTrigger", 1).json(str(polls))
    q = changes.watch(listings, str(tmp_path / "snap"), lambda df, i: seen.update({i: sorted(tuple(r) for r in df.collect())}), str(tmp_path / "ck"), 0.1).start()
    try:
        for i, rows in enumerate([[("a", 1.0, "x"), ("b", 1.0, "x")], [("a", 2.0, "y"), ("b", 2.0, "x")], [("b", 2.0, "x"), ("c", 3.0, "z")]]):
            (polls / f"{i}.json.tmp").write_text("\n".join(json.dumps({"poll_id": i, "rel": r, "mtime": m, "digest": d, "size": 1}) for r, m, d in rows))
            (polls / f"{i}.json.tmp").rename(polls / f"{i}.json")
            q.processAllAvailable()
    finally:
        q.stop()
    assert list(seen.values()) == [[("a", "created"), ("b", "created")], [("a", "modified")], [("a", "deleted"), ("c", "created")]]


def test_calls_of_one_name_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from stratalode.operators import code

    f = spark.range(40).selectExpr("concat('f', id) as qualname", "'x' as name", "'m' as rel")
    c = spark.range(400).selectExpr("concat('c', id) as caller", "'x' as callee", "'m' as rel").coalesce(1)
    got = code.call_edges(f, c)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 16000 and max(sizes) < 8000 and got.distinct().count() == 16000
    assert got.select("src").first().src.startswith("m::c")
    assert {(r.src[0], r.dst[0]) for r in code.call_edges(f, c, qualified=False).limit(50).collect()} == {("c", "f")}
