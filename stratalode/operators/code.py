"""Analyses over fact tables: smells, dead code, imports, call and module graphs, interface wiring, drift, coverage, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name, parent, route, route_key
from . import containment, relational
from .connections import server_routes, ui_calls  # noqa: F401  the two sides of orphans()

# Function names that are called from outside.
EXEMPT = ("main", "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule")
EXEMPT_PREFIXES = ("test_", "on_", "handle_", "do_", "setup_", "teardown_", "_")
# Event calls of sockets.
EMIT, LISTEN = r"""(?i)(?:socket|ws|io)\s*\.\s*emit\s*\(\s*['"]([^'"]+)['"]""", r"""(?i)(?:socket|ws|io)\s*\.\s*on\s*\(\s*['"]([^'"]+)['"]"""
#: Functions that go to all tasks of a join with calls.
FUNCTIONS = 500_000


def smells(functions: DataFrame, classes: DataFrame, tries: DataFrame, constants: DataFrame) -> DataFrame:
    """rel, line, smell, severity, metric. Each test reads one fact table; magic numbers count once a line and value."""
    f = lambda test, smell, metric, severity="MEDIUM": functions.where(test).select("rel", "line", F.lit(smell).alias("smell"), F.lit(severity).alias("severity"), F.col(metric).cast("double").alias("metric"))
    c = lambda test, smell, metric: classes.where(test).select("rel", "line", F.lit(smell).alias("smell"), F.lit("MEDIUM").alias("severity"), F.col(metric).cast("double").alias("metric"))
    parts = [
        f("n_lines > 50", "long_function", "n_lines"), f("n_params > 5", "too_many_params", "n_params"), f("complexity > 10", "high_complexity", "complexity", "HIGH"), f("nesting > 4", "deep_nesting", "nesting"),
        f("mutable_default", "mutable_default", "n_params"), f("n_returns > 5", "many_returns", "n_returns", "LOW"), c("n_lines > 300", "long_class", "n_lines"), c("n_methods > 20", "many_methods", "n_methods"),
        tries.where("is_bare").select("rel", F.col("handler").alias("line"), F.lit("bare_except").alias("smell"), F.lit("MEDIUM").alias("severity"), F.lit(None).cast("double").alias("metric")),
        constants.select("rel", "line", F.lit("magic_number").alias("smell"), F.lit("LOW").alias("severity"), F.expr("try_cast(value as double)").alias("metric")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dead_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """The first definition of each name of 5 lines or more that nothing calls."""
    exempt = F.col("name").isin(*EXEMPT)
    for p in EXEMPT_PREFIXES:
        exempt = exempt | F.col("name").startswith(p)
    first = functions.where(~exempt & (F.col("n_lines") >= 5)).groupBy("name").agg(F.min_by(F.struct("rel", "line", "n_lines"), F.struct("rel", "line")).alias("f"))
    return relational.dead(first.select("name", "f.*"), calls.select(F.col("callee").alias("name")), "name")


def unused_imports(imports: DataFrame, names: DataFrame, strings: DataFrame) -> DataFrame:
    """Imported names that the file neither uses nor mentions within a string. A name imported twice counts at its last line."""
    own = imports.where("module != '__future__' and bound != '*'").groupBy("rel", "bound").agg(F.max("line").alias("line"), F.max_by("module", "line").alias("module"))
    used = names.select("rel", F.col("name").alias("bound")).distinct()
    left = own.join(used, ["rel", "bound"], "left_anti")
    said = containment.pairs(strings, "value", left, "bound", by=("rel",))
    return left.join(said, ["rel", "bound"], "left_anti")


def call_edges(functions: DataFrame, calls: DataFrame, qualified: bool = True) -> DataFrame:
    """src, dst (rel::qualname, or bare names if not qualified) for each call and each function of the called name.

    The result may be far larger than both tables, with most rows from a few names, so calls are dealt evenly over the shuffle partitions
    instead of by name, and functions go to all tasks; only more than FUNCTIONS of them are joined by a shuffle.
    """
    of = lambda c: F.concat_ws("::", "rel", c) if qualified else F.col(c)
    to = functions.select(F.col("name").alias("callee"), of("qualname").alias("dst"))
    if to.count() <= FUNCTIONS:
        to = F.broadcast(to)
    own = calls.where("caller != '<module>'").select(of("caller").alias("src"), "callee")
    own = own.repartition(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "callee")
    return own.join(to, "callee").select("src", "dst")


def call_nodes(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with degrees, entries (marked, or without callers) and leaves (calling nothing here, not private)."""
    out_, in_ = edges.groupBy("src").agg(F.count(F.lit(1)).alias("calls")), edges.groupBy("dst").agg(F.count(F.lit(1)).alias("callers"))
    n = functions.withColumn("key", F.concat_ws("::", "rel", "qualname")).join(out_, F.col("key") == F.col("src"), "left").join(in_, F.col("key") == F.col("dst"), "left")
    n = n.select("key", "rel", "name", "line", "is_entry", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("callers", F.lit(0)).alias("callers"))
    return n.withColumn("entry", F.col("is_entry") | (F.col("callers") == 0)).withColumn("leaf", (F.col("calls") == 0) & ~F.col("name").startswith("_"))


def recursion(functions: DataFrame, calls: DataFrame) -> DataFrame:
    f = functions.select("rel", "qualname", "name")
    return calls.join(f, (calls.rel == f.rel) & (calls.caller == f.qualname) & (calls.callee == f.name), "left_semi").select("rel", "caller", "line").distinct()


def module_edges(imports: DataFrame, files: DataFrame, full: bool = False) -> DataFrame:
    """src, dst between local modules. By default a target is the first dotted part; full also tries whole names."""
    own = files.where("lang = 'python'").select(module_name(F.col("rel")).alias("module")).distinct()
    target = F.col("module") if full else F.split("module", r"\.")[0]
    e = imports.where("not relative").select(module_name(F.col("rel")).alias("src"), target.alias("dst")).distinct()
    return e.join(own, F.col("dst") == own["module"], "left_semi").where("src != dst")


def layers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules with layer (test, app, lib) and the external packages they import."""
    m = files.where("lang = 'python'").select(module_name(F.col("rel")).alias("module"), parent(F.col("rel")).alias("dir"), F.when(F.col("rel").rlike(r"(^|/)tests?/|(^|/)test_"), "test").when(F.col("rel").rlike(r"(^|/)(main|app|cli|__main__)\.py$"), "app").otherwise("lib").alias("layer"))
    out = imports.where("not relative").select(F.split("module", r"\.")[0].alias("module")).distinct()
    ext = out.join(m.select(F.split("module", r"\.")[0].alias("module")).distinct(), "module", "left_anti")
    return m.unionByName(ext.select("module", F.lit(None).cast("string").alias("dir"), F.lit("external").alias("layer")))


def orphans(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes of one side only by their other normal form: HIGH for writes of the interface, LOW for the server's."""
    c, r = calls.select(route_key(F.col("url")).alias("key"), "method"), routes.select(route_key(F.col("url")).alias("key"))
    front = c.join(r.distinct(), "key", "left_anti").groupBy("key").agg(F.max(F.col("method").isin("POST", "PUT", "DELETE")).alias("w"))
    front = front.select("key", F.lit("frontend").alias("side"), F.when(F.col("w"), "HIGH").otherwise("MEDIUM").alias("severity"))
    back = r.distinct().join(c.select("key").distinct(), "key", "left_anti").select("key", F.lit("backend").alias("side"), F.lit("LOW").alias("severity"))
    return front.unionByName(back)


def socket_orphans(files: DataFrame) -> DataFrame:
    """Events emitted but not listened to, and the reverse."""
    of = lambda p: files.select(F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("event")).distinct()
    e, n = of(EMIT), of(LISTEN)
    return e.join(n, "event", "left_anti").select("event", F.lit("emit").alias("side")).unionByName(n.join(e, "event", "left_anti").select("event", F.lit("listen").alias("side")))


def tested(names: DataFrame, uses: DataFrame) -> DataFrame:
    """Adds covered: whether tests use the name; end slashes don't matter."""
    u = uses.select(F.rtrim("name", F.lit("/")).alias("__n")).distinct()
    return names.join(u, F.rtrim("name", F.lit("/")) == F.col("__n"), "left").withColumn("covered", F.col("__n").isNotNull()).drop("__n")


def contract_endpoints(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Declared endpoints (url, method) with the first file that serves them; those without one are HIGH."""
    first = routes.groupBy(route(F.col("url")).alias("r")).agg(F.min("rel").alias("rel"))
    w = wanted.join(first, route(F.col("url")) == F.col("r"), "left").drop("r")
    return w.withColumn("severity", F.when(F.col("rel").isNull(), "HIGH"))


def undeclared(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    return relational.new_against(routes.select("url", "method").distinct(), wanted.select("url", "method"), ["url", "method"])


def missing_packages(imports: DataFrame, declared: DataFrame, local: DataFrame, standard: list[str]) -> DataFrame:
    """Imported top-level packages that are neither standard, local nor declared (also by a name within the other)."""
    from ..functions.text import package

    top = imports.where("not relative").select(package(F.split("module", r"\.")[0]).alias("package")).where("package != ''").distinct()
    top = top.where(~F.col("package").isin([s.replace("_", "-") for s in standard]))
    top = top.join(local.select(package(F.col("module")).alias("package")).distinct(), "package", "left_anti")
    d = declared.select(F.col("package").alias("p")).where("p != ''").distinct()
    held = containment.pairs(top, "package", d, "p").select("package").union(containment.pairs(d, "p", top, "package").select("package"))
    return top.join(held, "package", "left_anti")
