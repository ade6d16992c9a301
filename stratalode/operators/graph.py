"""Circular structure of directed graphs: strongly connected components and simple cycles, of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, stored


def _trimmed(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out: what lies on no cycle falls off from the ends."""
    n = edges.count()
    while n:
        ends = edges.select(F.col("src").alias("dst")).distinct()
        starts = edges.select(F.col("dst").alias("src")).distinct()
        left = rounds.keep(edges.join(ends, "dst", "left_semi").join(starts, "src", "left_semi").select("src", "dst"), "trimmed")
        m = left.count()
        edges = left
        if m == n:
            break
        n = m
    return edges


def _coloured(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """node, colour: the smallest node from which there is a path to it. Each round only nodes that got a new colour hand it on."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = rounds.keep(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while not colours.where("new").isEmpty():
        handed = colours.where("new").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("colour").alias("offer"))
        better = F.col("offer") < F.col("colour")
        step = colours.join(handed, F.col("node") == F.col("to"), "left")
        colours = rounds.keep(step.select("node", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), F.coalesce(better, F.lit(False)).alias("new")), "colours")
    return colours.select("node", "colour")


def _reaching(edges: DataFrame, colours: DataFrame, rounds: Rounds) -> DataFrame:
    """node, colour for the nodes that reach the node their colour is named after, against edges of one colour."""
    found = rounds.keep(colours.where("node = colour").withColumn("new", F.lit(True)), "found")
    while not found.where("new").isEmpty():
        back = found.where("new").join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "colour").distinct()
        more = back.join(found.select("node"), "node", "left_anti").withColumn("new", F.lit(True))
        found = rounds.keep(found.withColumn("new", F.lit(False)).unionByName(more), "found")
    return found.select("node", "colour")


def components(edges: DataFrame) -> DataFrame:
    """node, component, size of the strongly connected components of two nodes or more; a component is named after its smallest node.

    A node's colour is the smallest node that reaches it, and nodes of one component share theirs. Those that reach the node
    their colour is named after are its component. They leave, and the rest goes on along edges of one colour, until no edge is left.
    Loops, repeated edges and edges with a null end don't count. All rounds are joins and grouped sums, written and read again.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark, "components")
    shape = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).schema
    left = _trimmed(stored(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "edges"), rounds)
    parts = []
    while not left.isEmpty():
        colours = _coloured(left, rounds)
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023,E731
        inner = rounds.keep(left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"), "inner")
        found = stored(_reaching(inner, colours, rounds), "component")
        parts.append(found)
        gone = found.select("node")
        rest = inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left = _trimmed(rounds.keep(rest, "left"), rounds)
    out = spark.createDataFrame([], shape)
    for p in parts:
        out = out.unionByName(p.select("node", F.col("colour").alias("component")))
    sizes = out.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return out.join(sizes, "component").select("node", "component", "size")


def _single(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Cycles (path) of nodes with one edge each, and the edges that may lie on others.

    A walk along such nodes is one function, so it is followed by squaring: after k rounds `to` lies 2^k steps ahead. Its images shrink
    to the cycles, and when they stay as many, they are the cycles; the smallest node and its distance follow by squaring again. Rounds
    grow with the logarithm of the longest walk. Of the other edges those stay that don't lead to such a cycle: walks that end there never return.
    """
    one = edges.groupBy("src").agg(F.min("dst").alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("src").alias("node"), "to")
    one = stored(one, "single")
    walks, n = one, -1  # a walk that comes to a node with no edge or several stays there
    while True:
        m = walks.select("to").join(one.select(F.col("node").alias("to")), "to", "left_semi").distinct().count()
        if m == n or not m:
            break
        n = m
        walks = rounds.keep(walks.join(walks.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "walks")
    if not m:
        return edges.limit(0).select(F.array("src", "dst").alias("path")), edges
    on = stored(walks.join(one.select(F.col("node").alias("to")), "to", "left_semi").select(F.col("to").alias("node")).distinct(), "circle")
    gone = walks.join(on.withColumnRenamed("node", "to"), "to", "left_semi").select("node")
    # best: the smallest of the first `step` nodes from here, and how far ahead it is; a whole turn finds the cycle's smallest
    at = rounds.keep(one.join(on, "node").select("node", "to", F.struct(F.col("node").alias("least"), F.lit(0).cast("long").alias("far")).alias("best")), "turns")
    step, same = 1, False
    while not same:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("best").alias("other"))
        other = F.struct(F.col("other.least").alias("least"), (F.col("other.far") + step).alias("far"))
        took = at.join(ahead, "to").select("node", F.col("next").alias("to"), F.least("best", other).alias("best"), (F.col("other.least") < F.col("best.least")).alias("better"))
        at = rounds.keep(took, "turns")
        same, step = at.where("better").isEmpty(), 2 * step
    turn = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("best.far")).alias("place"), "node"))), lambda x: x["node"])  # the farthest from the smallest comes after it
    found = at.groupBy(F.col("best.least").alias("first")).agg(turn.alias("rest"))
    paths = found.select(F.concat(F.array("first"), F.array_remove("rest", F.col("first"))).alias("path"))
    left = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return stored(paths, "turns"), stored(left.select("src", "dst"), "left")


def circular(edges: DataFrame, most: int | None = None) -> DataFrame:
    """path, length of every simple cycle of two nodes or more (of `most` at most, if given), each once and from its smallest node.

    Cycles of nodes with one edge each come from squaring (_single). The other paths grow within a component only, through nodes
    larger than their first, and never over a node twice, so they end by themselves. A component with many edges has a number of cycles that grows exponentially, and they are the result; see
    components() for an account of it that does not.
    """
    edges = stored(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "edges")
    turns, edges = _single(edges, Rounds(edges.sparkSession, "single"))
    if most is not None:
        turns = turns.where(F.size("path") <= most)
    comps = stored(components(edges), "components")
    at = lambda end: comps.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    inner = edges.join(at("src"), "src").join(at("dst"), "dst").where("src_in = dst_in")
    inner = stored(inner.select("src", "dst"), "inner")
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    paths = stored(inner.where("src < dst").select(F.array("src", "dst").alias("path")), "paths")
    out, k = turns, 2
    while (most is None or k <= most) and not paths.isEmpty():
        out = out.unionByName(paths.join(inner, (last == F.col("src")) & (first == F.col("dst")), "left_semi"))
        grown = paths.join(inner, last == F.col("src")).where((F.col("dst") > first) & ~F.array_contains("path", F.col("dst")))
        paths = stored(grown.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        k += 1
    return out.select("path", F.size("path").alias("length"))
