"""Calls and routes with their places, as small applications of several frameworks have them."""

from stratalode.operators import connections, offsets, relational
from stratalode.sources import tree


def both(spark, **texts):
    files = tree.from_table(spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "rel string, content string"), "rel", "content")
    return connections.ui_calls(files), connections.server_routes(files)


FAR = "#" * 130 + "\n"


def test_methods_lines_and_input(spark):
    calls, routes = both(
        spark,
        server__js="app.get('/api/items', f)\n" + FAR + "router.delete('/api/items/:id', (req) => req.params.id)\n" + FAR + "app.use('/static', s)\n",
        flask__py="x = 1\n\n@app.route('/api/users', methods=['POST'])\ndef f():\n    return request.json\n" + "\n" * 40 + FAR + "@app.route('api/plain')\ndef g():\n    pass\n",
        page__html="<form action='/api/send'>\n" + "<!--" + FAR + "<a href='/api/items'>\n<a href='/else'>\nfetch('http://x/api/far')\nfetch('//x/y')\n",
        app__js="fetch('/api/items?x=1')\n" + FAR + "axios.post('/api/users', {\n  method: 'put'})\n" + FAR + "fetch('/api/items?x=1')\n",
    )
    assert sorted((r.rel, r.line, r.kind, r.url, r.method, r.receives_input) for r in routes.collect()) == [
        ("flask.py", 3, "flask", "/api/users", "POST", True), ("flask.py", 47, "flask", "/api/plain", "ANY", False),
        ("server.js", 1, "express", "/api/items", "GET", True), ("server.js", 3, "express", "/api/items/:id", "DELETE", False), ("server.js", 5, "express", "/static", "ANY", False),
    ]
    assert sorted((r.rel, r.line, r.kind, r.url, r.method) for r in calls.collect()) == [
        ("app.js", 1, "fetch", "/api/items", "UNKNOWN"), ("app.js", 3, "axios", "/api/users", "PUT"), ("app.js", 6, "fetch", "/api/items", "UNKNOWN"),
        ("page.html", 1, "form_action", "/api/send", "POST"), ("page.html", 3, "href", "/api/items", "UNKNOWN"),
    ]
    got = {(r.side, r.rel, r.line): (r.status, r.cardinality) for r in connections.connected(calls, routes).collect()}
    assert got["ui", "app.js", 1] == got["backend", "server.js", 1] == ("wired", "many:1") and got["ui", "app.js", 3] == ("wired", "1:1")
    assert got["backend", "server.js", 3] == ("orphan_backend", None) and got["ui", "page.html", 1] == ("orphan_ui", None) and len(got) == 10


def test_empty(spark):
    calls, routes = both(spark, a__py="", b__js="x")
    assert connections.connected(calls, routes).collect() == []


def test_fingerprints_are_those_of_the_lines_around(spark):
    text = ["A = 1  # c", "", "b  =  2", "# only", "c", "d", "e", "f", "g", "h", "i", "j"] * 3
    df = spark.createDataFrame([("k", "\n".join(text))], "key string, text string")
    lines = offsets.lines(df, "key", "text")
    import hashlib
    import re

    norm = [re.sub(r"\s+", " ", re.sub(r"(#|//).*$", "", t)).strip(" ").lower() for t in text]
    want = {i + 1: hashlib.sha256("\n".join(t for t in norm[max(0, i - 5) : i + 6] if t).encode()).hexdigest() for i in range(len(text))}
    assert {r.line: r.context_hash for r in relational.fingerprints(lines, lines.select("key", "line"), "key").collect()} == want
    assert [r.line for r in relational.fingerprints(lines, spark.createDataFrame([("k", 7), ("k", 7), ("z", 1)], "key string, line int"), "key").collect()] == [7]
    plan = relational.fingerprints(lines, lines.select("key", "line"), "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "between" not in plan.lower().split("window")[0]
