"""Interface analyses on small source texts."""

from stratalode.operators import facts, interfaces, offsets
from stratalode.sources import tree

SCRIPT = "const x = 1;\nfetch('/api/users')\n  .then(data => data.name)\nconst { email, age: a } = data;\nsend({ 'role': 1 });\n"
SERVER = "class User(BaseModel):\n    name: str\n    nick: Optional[str]\n    _own: int\n\n@app.get('/api/users')\ndef users():\n    return User(request.args)\n"


def lines(spark, *rows):
    f = tree.from_table(spark.createDataFrame(list(rows), "rel string, content string"), "rel", "content")
    return f, offsets.lines(f, "rel", "content")


def test_fields_and_drift(spark):
    f, ls = lines(spark, ("a.js", SCRIPT), ("b.py", SERVER))
    used = interfaces.script_fields(ls.where("rel = 'a.js'"))
    assert {(r.field, r.use) for r in used.collect()} >= {("name", "read"), ("email", "read"), ("age", "read"), ("role", "sent")}
    fields = facts.fact(facts.extract(f), "fields")
    assert {(r.model, r.field, r.type) for r in fields.collect()} == {("User", "name", "str"), ("User", "nick", "Optional[str]"), ("User", "_own", "int")}
    ends = interfaces.endpoints_with_input(ls.where("rel = 'b.py'"))
    assert [(r.method, r.url, r.receives_input) for r in ends.distinct().collect()] == [("GET", "/api/users", True)]
    at = interfaces.surroundings(ls.where("rel = 'b.py'"), 0, 29).join(ends.select("line", "url").distinct(), "line")
    models = interfaces.endpoint_models(at, fields)
    assert [(r.url, r.model) for r in models.collect()] == [("/api/users", "User")]
    drift = {(r.field, r.kind) for r in interfaces.field_drift(fields, used.where("use = 'read'"), models).collect()}
    assert ("nick", "unused") in drift and ("email", "missing") in drift and not any(f == "_own" for f, _ in drift)


def test_tests_and_slices(spark):
    f, ls = lines(spark, ("tests/test_x.py", "from pkg.a import one, two\ndef test_one():\n    one()\n    get('/api/users/')\n"), ("pkg/a.py", "import os\n\ndef one():\n    a = 1\n    return a\n"))
    assert {"one", "two", "/api/users/"} <= {r.name for r in interfaces.test_uses(ls).collect()}
    got = interfaces.code_slice(ls, facts.fact(facts.extract(f), "functions"), spark.createDataFrame([("pkg/a.py", 4)], "rel string, line long")).first()
    assert got.slice == "   def one():\n>>     a = 1\n       return a"


def test_parameters_and_impact(spark):
    c = spark.createDataFrame([("a.js", "/u/{id}", "k"), ("b.js", "/u/{x}", "k"), ("a.js", "/v/{id}", "m")], "rel string, url string, key string")
    r = spark.createDataFrame([("s.py", "/u/<user>", "k"), ("s.py", "/v/<id>", "m")], "rel string, url string, key string")
    assert [x.key for x in interfaces.parameter_mismatches(c, r).collect()] == ["k"]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    risk = spark.createDataFrame([("a", 10.0)], "node string, score double")
    assert {x.node: (x.level, x.impact) for x in interfaces.impact(risk, e, 1).collect()} == {"a": (0, 12.5), "b": (1, 3.0), "c": (2, 1.0)}
