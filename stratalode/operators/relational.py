"""Joins, sets, windows and bounded graph steps over fact tables. Inputs are DataFrames with the named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_against(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of now whose key is not in before. Null keys match null keys."""
    b = before.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return now.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: new, resolved and unchanged distinct keys, and the raw totals of both sides."""
    o, n = old.select(*keys).distinct(), new.select(*keys).distinct()
    counts = [
        new_against(n, o, keys).agg(F.count(F.lit(1)).alias("new")), new_against(o, n, keys).agg(F.count(F.lit(1)).alias("resolved")),
        n.intersect(o).agg(F.count(F.lit(1)).alias("unchanged")), old.agg(F.count(F.lit(1)).alias("old_total")), new.agg(F.count(F.lit(1)).alias("new_total")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # one row each


def changed(now: DataFrame, snapshot: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of now that the snapshot lacks or has with another digest."""
    s = snapshot.select(F.col(key).alias("__k"), F.col(digest).alias("__d"))
    return now.join(s, F.col(key) == F.col("__k"), "left").where(~F.col(digest).eqNullSafe(F.col("__d"))).drop("__k", "__d")


def outside_intervals(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """Rows that no span of their key covers, ends included."""
    s = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(first).alias("__a"), F.col(last).alias("__b"))
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__{k}") for k in keys])
    return rows.join(s, on & (F.col(at) >= F.col("__a")) & (F.col(at) <= F.col("__b")), "left_anti")


def range_marks(marks: DataFrame, keys: list[str], at: str, opens: Column, end: Column) -> DataFrame:
    """Spans (keys, first, last) from opening and closing marks, the latest open one closed first; open ones run to `end`.

    The nesting depth pairs them: a close belongs to the last open mark of its depth.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    m = marks.withColumn("__open", opens.cast("int"))
    depth = F.sum(F.when(F.col("__open") == 1, 1).otherwise(-1)).over(order)
    m = m.withColumn("__depth", depth + F.when(F.col("__open") == 1, 0).otherwise(1))
    nxt = Window.partitionBy(*keys, "__depth").orderBy(at)
    m = m.withColumn("__close", F.when(F.lead("__open").over(nxt) == 0, F.lead(at).over(nxt)))
    return m.where("__open = 1").select(*keys, F.col(at).alias("first"), F.coalesce("__close", end).alias("last"))


def duplicate_blocks(lines: DataFrame, key: str, size: int = 6) -> DataFrame:
    """Runs of `size` code lines that occur twice: digest, occurrences, keys, first place.

    Lines are trimmed; blank and comment lines go. `dense` numbers what is left, from 0, within a
    key. A block found under one key only counts if its places span at least `size` lines.
    """
    code = lines.select(key, "line", F.trim("text").alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    order = Window.partitionBy(key).orderBy("line")
    code = code.withColumn("dense", (F.row_number().over(order) - 1).cast("long"))
    block = F.collect_list("t").over(order.rowsBetween(0, size - 1))
    blocks = code.withColumn("__b", block).where(F.size("__b") == size).select(key, "line", "dense", F.sha2(F.array_join("__b", "\n"), 256).alias("digest"))
    first = F.min(F.struct(key, "dense", "line"))
    got = blocks.groupBy("digest").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(key).alias("keys"), first.alias("f"), (F.max("dense") - F.min("dense")).alias("span"))
    got = got.where((F.col("occurrences") >= 2) & ((F.col("keys") > 1) | (F.col("span") >= size)))
    return got.select("digest", "occurrences", "keys", F.col(f"f.{key}").alias("first_key"), F.col("f.line").alias("first_line"))


def cochange(commits: DataFrame, commit: str, path: str, least: int = 3) -> DataFrame:
    """Pairs a < b in at least `least` common commits, with strength as a percentage of all commits.

    Paths of fewer commits than that can be in no such pair, so they leave before the self-join.
    """
    c = commits.select(commit, path).distinct()
    kept = c.groupBy(path).count().where(F.col("count") >= least).select(path)
    pairs = c.join(kept, path, "left_semi")
    a, b = pairs.select(commit, F.col(path).alias("a")), pairs.select(commit, F.col(path).alias("b"))
    n = c.agg(F.countDistinct(commit).alias("commits"))
    got = a.join(b, commit).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)
    return got.crossJoin(F.broadcast(n)).select("a", "b", "together", F.bround(100.0 * F.col("together") / F.col("commits"), 1).alias("strength"))


def hotspots(changes: DataFrame, path: str, skip: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Changes of each path that holds none of the skipped parts, most first, ties by path."""
    rows = changes
    for s in skip:
        rows = rows.where(~F.col(path).contains(s))
    out = rows.groupBy(path).agg(F.count(F.lit(1)).alias("changes"))
    return out.orderBy(F.desc("changes"), path).limit(most) if most else out


def coupling(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Afferent and efferent degree (distinct, no loops) and instability of each node; 0.5 for isolated ones."""
    e = edges.where("src != dst").select("src", "dst").distinct()
    out_ = e.groupBy("src").agg(F.count(F.lit(1)).alias("ce"))
    in_ = e.groupBy("dst").agg(F.count(F.lit(1)).alias("ca"))
    df = nodes.join(out_, F.col(node) == F.col("src"), "left").join(in_, F.col(node) == F.col("dst"), "left")
    df = df.select(node, F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    total = F.col("ca") + F.col("ce")
    inst = F.when(total == 0, F.lit(0.5)).otherwise(F.bround(F.col("ce") / total, 2))
    return df.withColumn("instability", inst)


def hubs(degrees: DataFrame, node: str, least: int = 3) -> DataFrame:
    d = degrees.where((F.col("ca") >= least) & (F.col("ce") >= least))
    return d.select(node, "ca", "ce", (F.col("ca") * F.col("ce")).alias("score"))


def within_hops(edges: DataFrame, seeds: DataFrame, node: str, hops: int = 2) -> DataFrame:
    """node, level: the fewest undirected steps from a seed, up to `hops`."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = seeds.select(F.col(node).alias("n")).distinct().withColumn("level", F.lit(0))
    for k in range(1, hops + 1):
        step = reached.where(F.col("level") == k - 1).join(both, F.col("n") == F.col("src")).select(F.col("dst").alias("n"), F.lit(k).alias("level"))
        reached = reached.unionByName(step).groupBy("n").agg(F.min("level").alias("level"))
    return reached.select(F.col("n").alias(node), "level")


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """Simple cycles of 2 to `most` nodes, each once, from its smallest node. Paths only grow through larger nodes."""
    e = edges.where("src != dst").select("src", "dst").distinct()
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    out = None
    for k in range(2, most + 1):
        last = F.element_at("path", -1)
        closed = paths.join(e, (last == F.col("src")) & (F.get("path", F.lit(0)) == F.col("dst")), "left_semi")
        out = closed if out is None else out.unionByName(closed)
        if k < most:
            grown = paths.join(e, last == F.col("src")).where((F.col("dst") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("dst")))
            paths = grown.select(F.concat("path", F.array("dst")).alias("path"))
    return out.select("path", F.size("path").alias("length"))


def dead(defined: DataFrame, used: DataFrame, name: str) -> DataFrame:
    """Definitions whose name nothing uses."""
    return defined.join(used.select(F.col(name).alias("__n")).where("__n is not null").distinct(), F.col(name) == F.col("__n"), "left_anti")


def wiring(calls: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """Full outer meeting of callers and routes on their normal form, with status and cardinality."""
    c = calls.groupBy(key).agg(F.count(F.lit(1)).alias("n_calls"))
    r = routes.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("n_routes"))
    df = c.join(r, F.col(key) == F.col("__k"), "full_outer")
    df = df.select(F.coalesce(key, "__k").alias(key), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_routes", F.lit(0)).alias("n_routes"))
    status = F.when(F.col("n_routes") == 0, "orphan_ui").when(F.col("n_calls") == 0, "orphan_backend").otherwise("wired")
    kind = F.when((F.col("n_calls") == 1) & (F.col("n_routes") == 1), "1:1").when(F.col("n_calls") > 1, "many:1").otherwise("1:many")
    return df.withColumn("status", status).withColumn("cardinality", F.when(F.col("status") == "wired", kind))


def drift(model: DataFrame, seen: DataFrame) -> DataFrame:
    """Fields (model, field) of one side only: unused ones LOW (private ones aside), missing ones HIGH."""
    keys = ["model", "field"]
    unused = new_against(model.select(*keys).distinct(), seen, keys).where("field not like '\\\\_%'").select(*keys, F.lit("unused").alias("kind"), F.lit("LOW").alias("severity"))
    known = seen.join(model.select(F.col("model").alias("__m")).distinct(), F.col("model") == F.col("__m"), "left_semi")
    missing = new_against(known.select(*keys).distinct(), model, keys).select(*keys, F.lit("missing").alias("kind"), F.lit("HIGH").alias("severity"))
    return unused.unionByName(missing)


def fingerprints(lines: DataFrame, targets: DataFrame, key: str, around: int = 5) -> DataFrame:
    """Digest of the code around each target line: comments off, lower case, blank lines out. A window of lines, so a text is sorted once."""
    from ..functions.text import normal_line

    near = Window.partitionBy(key).orderBy("line").rangeBetween(-around, around)
    said = lines.select(key, "line", normal_line(F.col("text")).alias("t")).withColumn("ls", F.collect_list(F.when(F.col("t") != "", F.col("t"))).over(near))
    wanted = targets.select(key, F.col("line").cast("long").alias("line")).distinct()
    return said.where(F.size("ls") > 0).join(wanted, [key, "line"], "left_semi").select(key, "line", F.sha2(F.array_join("ls", "\n"), 256).alias("context_hash"))


def nth_occurrence(lines: DataFrame, key: str, scope: str) -> DataFrame:
    """Adds occurrence: how many equal lines the scope has up to this one."""
    w = Window.partitionBy(key, scope, F.trim("text")).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("occurrence", F.count(F.lit(1)).over(w))


def enclosing_scope(lines: DataFrame, key: str, opens: str = r"^\s*(?:async\s+def|def|class)\s+(\w+)") -> DataFrame:
    """Adds scope: the last def or class strictly above the line, whatever its indent; <module> if none."""
    name = F.nullif(F.regexp_extract("text", opens, 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("scope", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("<module>")))


def quote_parity(lines: DataFrame, key: str) -> DataFrame:
    """Adds in_docstring: an odd number of triple quotes stands on the lines before."""
    n = F.regexp_count("text", F.lit('"""')) + F.regexp_count("text", F.lit("'''"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("in_docstring", F.coalesce(F.sum(n).over(w), F.lit(0)) % 2 == 1)
