"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits
agree on at least three blocks, so every such pair shares one of the twenty block triples; triples
are the join keys, and the Hamming distance of what meets is then computed. Equal fingerprints
are one class from the start. Within a key, classes are compared tile against tile, and a tile
gives a spanning forest of its links, never all its pairs; the forest has the same
components. Components come from alternating star contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, broadcast_within, repeat_rows, split_words, stored, table

BITS = 3
BLOCKS = 6
#: Classes of a key that are compared with one another in one task.
TILE = 2048
#: Links in a written part of components.
EDGES = 1_000_000


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (bigint), rows (how many there are) for each distinct (doc_id, text)."""
    words = split_words(ascii_lower(F.coalesce("text", F.lit(""))), SPACES)
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), words.alias("words"))
    at = docs.select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "w"))
    at = at.where(F.col("pos").isNull() | (F.col("pos") <= F.greatest(F.size("words") - size, F.lit(0))))
    h = F.xxhash64(F.concat_ws(" ", *[F.get("words", F.col("pos") + i) for i in range(size)]))
    first = (F.coalesce("pos", F.lit(0)) == 0).cast("int")
    at = at.select("doc_id", "key", F.when(F.col("pos").isNotNull(), h).alias("h"), first.alias("first"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(0x100000001))).alias(f"s{i}") for i in range(32)]  # two counters in each sum
    sums = at.groupBy("doc_id", "key").agg(F.count("h").alias("n"), F.sum("first").alias("rows"), *lanes)
    fp = F.lit(0).cast("long")
    for i in range(32):
        for bit, c in ((i, F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"s{i}", 32))):
            value = (1 << bit) - (1 << 64) * (bit == 63)
            fp = fp.bitwiseOR(F.when(c * 2 > F.col("n"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return sums.select("doc_id", fp.alias("fp"), "rows")


def block_masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = [sum(c) for c in combinations(masks, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _forest(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Links within one tile, or between its two sides, as a spanning forest."""
    fp, node, side = pdf.fp.to_numpy(np.int64).view(np.uint64), pdf.node.to_numpy(), pdf.side.to_numpy()
    two = side.min() != side.max()
    left, right = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if two else (np.arange(len(fp)),) * 2
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in left:
        for j in right[np.bitwise_count(fp[right] ^ fp[i]) <= bits]:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})


def links(classes: DataFrame, bits: int = BITS, parts: int | None = None) -> DataFrame:
    """Links (a, b) between classes (node, fp) within the distance, enough of them to connect what is connected. With parts, tiles are dealt to as many tasks, however few their bytes."""
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(block_masks(bits=bits))])
    at = classes.select("node", "fp", F.explode(keys).alias("b")).select("node", "fp", "b.k", "b.v")
    several = at.groupBy("k", "v").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    at = at.join(several, ["k", "v"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = at.withColumn("with", other).select("node", "fp", "k", "v", F.least("chunk", "with").alias("x"), F.greatest("chunk", "with").alias("y"), F.col("chunk").alias("side"))
    tiles = tiles.repartition(*([parts] if parts else []), "k", "v", "x", "y")  # else all tiles of a frequent key would stay in the task of its join
    return tiles.groupBy("k", "v", "x", "y").applyInPandas(lambda pdf: _forest(pdf, bits), "a long, b long")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (its smallest node) for every node that has a link. With rows, the most that edges has, tables have a part for each EDGES of theirs.

    Alternates large and small stars. The smallest neighbour comes from an aggregate and a join,
    so a hub's neighbours never meet in one row.
    """

    def parted(df: DataFrame, most: int | None) -> DataFrame:
        return df if most is None else df.coalesce(1 + most // EDGES)

    edges = stored(parted(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(least, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = stored(parted(small, rows and 2 * rows), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last, rows = state, rows and state[0]


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links): one row for each row of docs, repeated ones too.

    A null or wordless text has fingerprint zero and is linked like any other; a text of fewer words than a
    shingle is one shingle. A bit that half of the shingles have (a tie) is 0. Rows without doc_id take part through the
    other documents of their class; a class of such rows alone has no component_id. Long texts are whole. No rows: no rows.
    Other columns are ignored.
    """
    fps = stored(fingerprints(docs.select("doc_id", "text"), size), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    far = components(links(classes.where("node is not null"), bits))
    moved = stored(classes.join(far, "node").where("component < node").select(F.col("fp").alias("f"), "component"), "moved")
    own = classes.withColumnRenamed("fp", "f")
    to = own.join(moved, "f", "left").select("f", F.coalesce("component", "node").alias("component_id"))
    return repeat_rows(fps.join(to, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id", "rows"), "rows")


def op9_simhash_near_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs, sf_dir):
    """Keeps one document of each group of near copies: five-word shingles with Jaccard similarity 0.8 or more, linked.

    SimHash brings together what is compared first; what it doesn't see is found by exact filters (`jaccard.near_copies`).

    That is the row with the smallest doc_id (null last), then text hash. Rows are told apart by doc_id and text; of rows that are
    equal in both one stays. Texts without words, and null, are copies of one another. No rows: no rows.
    """
    from .jaccard import near_copies

    rows = stored(near_copies(docs), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    many = rows.groupBy("grp").agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    at = [F.col("doc_id").alias("__id"), F.col("key").alias("__key")]
    parts = 1 + rows.count() // EDGES
    gone = stored(rows.join(many, "grp").where(rank != F.col("kept")).select(*at).distinct().coalesce(parts), "copies")
    twice = stored(rows.groupBy("doc_id", "key").count().where("count > 1").select(*at).coalesce(parts), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    gone, twice = (broadcast_within(df, df.count())[0] for df in (gone, twice))
    left = docs.join(gone, same, "left_anti")
    # only rows that are there more than once are compared as a whole, so texts are not shuffled
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
