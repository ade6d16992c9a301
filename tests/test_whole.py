"""Queries over whole tables against brute force on the small tables."""

from collections import Counter

import pyarrow.parquet as pq

from stratalode import catalog

D = "/root/testdata/sf0.001"


def load(name, *cols):
    t = pq.read_table(f"{D}/{name}.parquet", columns=list(cols))
    return list(zip(*(t.column(c).to_pylist() for c in cols), strict=True))


def run(spark, name):
    return catalog.QUERIES[name](spark, D).collect()


def edges():
    nation, buyer, seller = dict(load("customer", "c_custkey", "c_nationkey")), dict(load("orders", "o_orderkey", "o_custkey")), dict(load("supplier", "s_suppkey", "s_nationkey"))
    got = {(nation[buyer[o]], seller[s]) for o, s in load("lineitem", "l_orderkey", "l_suppkey") if buyer.get(o) in nation and s in seller}
    return {(a, b) for a, b in got if a != b}


def test_graph_sees_every_edge(spark):
    e = edges()
    ce, ca = Counter(a for a, _ in e), Counter(b for _, b in e)
    want = {n: (ca[n], ce[n]) for (n,) in load("nation", "n_nationkey")}
    assert {r.n_nationkey: (r.ca, r.ce) for r in run(spark, "coupling")} == want
    assert {r.n_nationkey: r.score for r in run(spark, "hub_nodes")} == {n: a * b for n, (a, b) in want.items() if min(a, b) >= 3}
    assert sum(r.nodes for r in run(spark, "instability_rank")) == len(want)


def test_calls_and_drift_see_every_customer(spark):
    c, s = load("customer", "c_custkey", "c_nationkey"), load("supplier", "s_suppkey", "s_nationkey")
    assert sorted((r.src, r.dst) for r in run(spark, "call_resolution")) == sorted((f"c{k}", f"s{j}") for k, n in c for j, m in s if n == m)
    model, seen = {(f"s{n}", f"f{k % 17}") for k, n in s}, {(f"s{n}", f"f{k % 19}") for k, n in c}
    missing = {x for x in seen - model if x[0] in {m for m, _ in model}}
    assert sorted(((r.model, r.field), r.kind) for r in run(spark, "schema_drift")) == sorted([(x, "unused") for x in model - seen] + [(x, "missing") for x in missing])


def test_findings_and_lines_are_all_counted(spark):
    every = run(spark, "source_findings")
    (gate,), (review,) = run(spark, "quality_gate"), run(spark, "project_review")
    n = Counter(r.severity for r in every)
    assert (gate.total, gate.high, gate.medium, gate.low) == (len(every), n["HIGH"], n["MEDIUM"], n["LOW"])
    assert (review.high, review.medium, review.low) == (n["HIGH"], n["MEDIUM"], n["LOW"])
    at = {(r.doc_id, r.line) for r in run(spark, "fingerprint")}
    assert {(i, k + 1) for i, t in load("documents", "doc_id", "text") for k, x in enumerate((t or "").split("\n")) if x.strip() and not x.strip().startswith(("#", "//"))} <= at


def test_cycles_of_four(spark):
    e = edges()
    to = {a: {b for x, b in e if x == a} for a, _ in e}
    want = []

    def grow(path):
        if len(path) > 1 and path[0] in to.get(path[-1], ()):
            want.append((">".join(map(str, path)), len(path)))
        if len(path) < 4:
            for b in to.get(path[-1], ()):
                if b > path[0] and b not in path:
                    grow([*path, b])

    for a in to:
        grow([a])
    assert max(n for _, n in want) == 4
    assert sorted((r.path, r.length) for r in run(spark, "cycles_len_le_4")) == sorted(want)
