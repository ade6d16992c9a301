"""Components, cycles, running sums and names within texts against brute force on random small inputs."""

import random

import pytest

from stratalode.operators import containment, graph, ordered, rollups


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def reach(edges):
    nodes = {x for e in edges for x in e}
    got = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in got[n]:
                got[n] |= got[k]
    return got


def components(edges):
    r = reach(edges)
    own = {n: min(m for m in r if m == n or (m in r[n] and n in r[m])) for n in r}
    sizes = {c: sum(v == c for v in own.values()) for c in own.values()}
    return sorted((n, c, sizes[c]) for n, c in own.items() if sizes[c] > 1)


def simple_cycles(edges):
    out, to = [], {}
    for a, b in set(edges):
        if a != b:
            to.setdefault(a, []).append(b)

    def grow(path):
        for b in to.get(path[-1], []):
            if b == path[0] and len(path) > 1:
                out.append(tuple(path))
            elif b > path[0] and b not in path:
                grow([*path, b])

    for n in to:
        grow([n])
    return sorted(out)


GRAPHS = {
    "a long cycle": [(i, (i + 1) % 7) for i in range(7)],
    "two that share a node": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (0, 1)],
    "chain and loops": [(i, i + 1) for i in range(6)] + [(3, 3), (6, 6)],
    "nested": [(1, 2), (2, 1), (2, 3), (3, 2), (1, 3), (9, 8), (8, 9), (3, 9)],
    "random": [(random.Random(i).randrange(14), random.Random(i + 99).randrange(14)) for i in range(22)],
    "no edge": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_cycles(spark, name):
    rows = GRAPHS[name] + GRAPHS[name][:2]
    edges = spark.createDataFrame([*rows, (None, 1), (1, None)], "src int, dst int")
    assert sorted(map(tuple, graph.components(edges).collect())) == components([e for e in rows if e[0] != e[1]])
    cycles = [tuple(r.path) for r in graph.circular(edges).collect()]
    assert sorted(cycles) == simple_cycles(rows)
    if name == "a long cycle":
        assert graph.circular(edges, 6).count() == 0


def test_long_walks_take_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    ring, other = rng.sample(range(1000), 150), rng.sample(range(1000, 1200), 11)
    turn = lambda x: list(zip(x, x[1:] + x[:1], strict=True))
    tail = [(3000 + i, 3001 + i) for i in range(120)] + [(3120, ring[7])]
    two = [(5000, 5001), (5001, 5000), (5001, 5002), (5002, 5000), (5000, ring[0])]
    tables, write = [], graph.stored
    keep = graph.Rounds.keep
    monkeypatch.setattr(graph, "stored", lambda df, name: tables.append(name) or write(df, name))
    monkeypatch.setattr(graph.Rounds, "keep", lambda self, df, what, *most: tables.append(what) or keep(self, df, what, *most))
    got = sorted(tuple(r.path) for r in graph.circular(spark.createDataFrame(turn(ring) + turn(other) + tail + two, "src int, dst int")).collect())
    rolled = lambda x: tuple(x[x.index(min(x)) :] + x[: x.index(min(x))])
    assert got == sorted([rolled(ring), rolled(other), (5000, 5001), (5000, 5001, 5002)]) and len(tables) < 60


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(4), rng.choice((1, 5, None))) for _ in range(500)] + [("b", 2, 3)] * 400
    df = spark.createDataFrame(rows, "k string, v int, n int")
    got = ordered.running(df, ["k", "-v"], "n", "total", "place", parts=7).collect()
    assert sorted(r.place for r in got) == list(range(1, 901))
    at, total = sorted(got, key=lambda r: r.place), 0
    assert [(r.k, r.v) for r in at] == sorted([(k, v) for k, v, _ in rows], key=lambda r: (r[0], -r[1]))
    for r in at:
        total += r.n or 0
        assert r.total == total
    assert sorted((r.k, r.v, r.n or 0) for r in got) == sorted((k, v, n or 0) for k, v, n in rows)
    assert ordered.running(df.limit(0), ["k"], "n", "total").collect() == []


def test_no_task_sorts_all_rows(spark):
    df = spark.range(4000).selectExpr("id % 3 as k", "1 as n")
    got = ordered.running(df, ["k"], "n", "total", parts=8)
    sizes = [r["count"] for r in got.groupBy((got.total / 500).cast("int")).count().collect()]
    windows = [x for x in plan_of(got).split("\n") if "Window" in x and "specifiedwindowframe" in x.lower()]
    assert sum(sizes) == 4000 and any("__part" in x for x in windows)


def test_batches_by_item(spark):
    f = spark.createDataFrame([(f"{p}-{i}", "m.py", i, s) for i, (p, s) in enumerate([("SEC", "HIGH"), ("QUAL", "HIGH"), ("PY", "LOW")] * 60)], "rule_id string, rel string, line long, severity string")
    s = spark.createDataFrame([("long_function", "m.py", 1, "HIGH")], "smell string, rel string, line long, severity string")
    got = sorted(rollups.sprint_batches(rollups.action_items(f, s)).collect(), key=lambda r: r.place)
    assert [r.roi for r in got] == sorted((r.roi for r in got), reverse=True) and len(got) == 181
    run = 0
    for r in got:
        run += {"SEC": 15, "QUA": 5, "PY-": 10}.get(r.id[:3], 15)
        assert r.running == run and r.batch == ("now" if run <= 240 else "next" if run <= 480 else "later" if run <= 960 else "backlog")
    summary = {r.batch: (r["items"], r.hours, r.pct_resolved) for r in rollups.batch_summary(rollups.sprint_batches(rollups.action_items(f))).collect()}
    assert summary["now"] == (48, 4.0, 27) and sum(x[0] for x in summary.values()) == 180 and summary["backlog"][2] == 100


def test_names_within_texts(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abé😀") for _ in range(rng.randrange(n)))
    texts, names = [(rng.randrange(3), text(14)) for _ in range(80)] + [(0, None), (1, "")], [(rng.randrange(3), text(6)) for _ in range(60)] + [(0, None), (1, "")]
    t, n = spark.createDataFrame(texts, "g int, t string"), spark.createDataFrame(names, "g int, n string")
    got = containment.pairs(t, "t", n, "n")
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for _, a in texts for _, b in names if a is not None and b and b in a})
    by = containment.pairs(t, "t", n, "n", by=("g",))
    assert sorted(map(tuple, by.collect())) == sorted({(g, a, b) for g, a in texts for h, b in names if g == h and a is not None and b and b in a})
    assert containment.pairs(t, "t", n.limit(0), "n").collect() == [] and containment.pairs(t.limit(0), "t", n, "n").collect() == []
    for df in (got, by):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_no_nested_loops_in_what_uses_it(spark):
    from stratalode.operators import code, interfaces, reports

    one = lambda *names: spark.createDataFrame([tuple("x" for _ in names)], ", ".join(f"{x} string" for x in names))
    imports = one("module", "bound", "rel").selectExpr("*", "1L as line", "false as relative")
    for df in (
        code.unused_imports(imports, one("rel", "name"), one("rel", "value")), code.missing_packages(imports, one("package"), one("module"), ["os"]),
        interfaces.endpoint_models(one("url", "context", "rel").selectExpr("*", "1 as line"), one("model")), reports.has_test(one("name"), one("rel")),
    ):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_fix_order_of_all(spark):
    rows = [("HIGH", 0.5, "safe", "A", "f", 1), ("HIGH", 0.9, "manual", "B", "f", 2), ("LOW", 0.9, "safe", "A", "f", 3), ("HIGH", 0.9, "safe", "C", "f", 4)]
    df = spark.createDataFrame(rows, "severity string, confidence double, tier string, rule_id string, rel string, line int")
    assert [r.line for r in sorted(rollups.plan(df).collect(), key=lambda r: r.place)] == [4, 2, 1, 3]
    assert [r.line for r in rollups.plan(df, 2).collect()] == [4, 2]


def test_names_that_rows_hold(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abé😀") for _ in range(rng.randrange(n)))
    texts, names = [(rng.randrange(9), text(14)) for _ in range(80)] + [(0, None), (1, "")], [(text(6),) for _ in range(40)] + [(None,), ("",)]
    t, n = spark.createDataFrame(texts, "g int, t string"), spark.createDataFrame(names, "n string")
    want = sorted({(g, b) for g, a in texts for (b,) in names if a is not None and b and b in a})
    for longest, most in ((3, 10**6), (8, 10**6), (2, 7)):
        monkeypatch.setattr(containment, "NAMES", most)
        assert sorted(map(tuple, containment.held(t, "t", n, "n", ("g",), longest).collect())) == want
    assert sorted(r.n for r in containment.held(t, "t", n, "n").collect()) == sorted({b for _, b in want})
    assert containment.held(t, "t", n.limit(0), "n", ("g",)).collect() == [] == containment.held(t.limit(0), "t", n, "n", ("g",)).collect()


def test_pairs_carry_no_texts(spark):
    import re

    from stratalode.operators import interfaces, reports

    routes = spark.createDataFrame([("/a", "x Item y", "r", 1), ("/a", "Order", "r", 2), (None, "Order Item", "q", 1), ("/b", None, "r", 1)], "url string, context string, rel string, line int")
    got = interfaces.endpoint_models(routes, spark.createDataFrame([("Item",), ("Order",)], "model string"))
    assert sorted(map(tuple, got.collect()), key=str) == [("/a", "Order"), (None, "Item"), (None, "Order")]
    tested = reports.has_test(spark.createDataFrame([("load",)], "name string"), spark.createDataFrame([("t/test_load.py",)], "rel string"))
    assert [r.has_test for r in tested.collect()] == [True]
    for df, column in ((got, "(context|__text)"), (tested, "(rel|__text)")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("Generate")[0]  # joins and aggregates that stand above the cut of the texts
        assert not re.search(rf"Aggregate \[[^\]]*\b{column}#", above), above


def test_models_meet_texts_without_a_join(spark, monkeypatch):
    from stratalode.operators import interfaces

    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("aabé😀漢_1 .\n") for _ in range(rng.randrange(n)))
    urls = ["/a", "/b", "/c", None, *(f"/{i}" for i in range(40))]
    routes = [(rng.choice(urls), text(30), rng.choice("rs"), i) for i in range(120)] + [("/n", "ab", "r", 1), ("/n", None, "r", 2), ("/e", "", "r", 1), ("/l", "b " + "xyz" * 30000 + "ab.1", "r", 1)]
    models = [text(7) for _ in range(150)] + ["", None, "ab", "xyzab", "zab.1", "zx" * 40, "a", "漢", "."]
    last = {u: t for u, t, _, _ in sorted(routes, key=lambda x: x[2:])}
    r = spark.createDataFrame(routes, "url string, context string, rel string, line int").cache()
    kinds = {"all": models, "letters": ["ab", "b", "aé", "漢a", "aa"], "words": ["a_", "1", "b1"], "none": []}
    for kind, most in (("all", 10**6), ("all", 40), ("letters", 10**6), ("words", 1), ("none", 5)):
        monkeypatch.setattr(containment, "NAMES", most)
        got = interfaces.endpoint_models(r, spark.createDataFrame([(x,) for x in kinds[kind]], "model string"))
        want = {(u, n) for u, t in last.items() for n in kinds[kind] if n and t and n in t}
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert "Join" not in plan_of(got)  # each text meets its names where it is, so no stretch of it is a row


def test_names_across_texts_and_places(monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("aabé😀漢_1 .") for _ in range(rng.randrange(n)))
    for i in range(200):
        texts, names = [rng.choice((None, text(20), text(40))) for _ in range(rng.randrange(9))], sorted({text(9) for _ in range(rng.randrange(30))} - {""})
        monkeypatch.setattr(containment, "PLACES", (1, 2, 3, 5, 17, 1 << 16)[i % 6])
        monkeypatch.setattr(containment, "LOAD", (4 << 20, 9)[i % 4 == 1])
        monkeypatch.setattr(containment, "FACTOR", (0x9E3779B97F4A7C15, 1)[i % 2])  # with 1, hashes are sums of bytes, which many names share
        known = containment._Names(names)
        got = known.held(pa.array(["aa", *texts], pa.string()).slice(1), containment._Sums(containment.PLACES + known.longest + containment.HEAD))
        assert [sorted(x) for x in got.to_pylist()] == [[n for n in names if t and n in t] for t in texts]
