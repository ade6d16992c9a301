"""Near copies by SimHash fingerprints of word shingles, with the exact Jaccard similarity as the check.

Fingerprints that differ in few bits meet by the block triples of `simhash.links`, equal ones through their smallest set, and what
meets is linked if the sets' similarity is SHARE or more. No number of bits bounds the similarity, so the links that fingerprints
don't see are found exactly: shingles have one fixed order, rare ones first as far as a sample tells. Of two sets with similarity
SHARE or more, each has a shingle of the other among its first n - ceil(SHARE n) + 1, so these
prefixes are the join keys and no pair is missed; the sample bears on speed only. Equal sets are one
class from the start. Each class of a key that SimHash has not connected yet is compared with others
drawn from it, and at last classes that are not yet connected with one another. Pairs whose sizes or parity sketches rule them out are not compared: a sketch
has two bits or more for each shingle, so its differing bits are a lower bound of the symmetric difference, and one that long sets do not fill.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import SPACES, ascii_lower, broadcast_within, in_small_batches, plan_bytes, split_words, stored
from .simhash import BITS, components, links

WORDS = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 4, 5
TILE = 512
#: Classes of a shingle up to which their pairs are fewer bytes than their sketches.
FEW = 8
#: Times that each shingle's classes are compared with one drawn from them, before those still apart are all compared.
TURNS = 2
SAMPLE = 4000
COMMON = 200_000
#: Bytes of prints that one written part of classes comes from.
PART = 16 << 20
#: Fewest 64-bit words of a sketch; a power of two.
LANES = 4


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words, from the words' hashes; of all words if they are fewer."""
    n = max(1, len(words) - size + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def sketch(mixed: np.ndarray) -> np.ndarray:
    """Parities of the mixed hashes: the upper bits choose a word, the lowest six its bit, so folding words in pairs gives the sketch of half the size."""
    words = max(LANES, 1 << max(0, (len(mixed) - 1) // 32).bit_length())
    at = (mixed >> np.uint64(65 - words.bit_length())).view(np.int64) * 64 + (mixed & np.uint64(63)).view(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * words).astype(np.uint8) & 1).view(np.int64)


def fingerprint(mixed: np.ndarray) -> np.int64:
    """SimHash of the mixed hashes: a bit is 1 if over half of them have it; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(mixed), 4096):
        ones += np.unpackbits(mixed[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(mixed)).view(np.int64)[0]


def _folded(x: Column) -> Column:
    """The sketch of half the size."""
    return F.transform(F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1), lambda i: F.get(x, 2 * i).bitwiseXOR(F.get(x, 2 * i + 1)))


def _may_match() -> Column:
    """Whether sizes and sketches of sides a and b, if there, leave the similarity possible. Of sizes that do, one sketch is at most twice the other."""
    a, b = F.col("n_a"), F.col("n_b")

    x, y = F.col("sketch_a"), F.col("sketch_b")
    same = lambda x, y: F.when(F.size(x) > F.size(y), _folded(x)).otherwise(x)
    bits = F.zip_with(same(x, y), same(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda t, n: t + n)
    return (DEN * F.least(a, b) >= NUM * F.greatest(a, b)) & F.coalesce((NUM + DEN) * apart <= (DEN - NUM) * (a + b), F.lit(True))


def _sets(size: int, common: tuple[np.ndarray, np.ndarray] | None, whole: bool):
    """Batches of key, words to key, node, n, fp, sketch and prefix, or to node and the whole set."""

    def run(batches):
        for b in batches:
            lists = b.column("words")
            flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            nodes, ns, fps, maps, parts = [], [], [], [], []
            for i, j in zip(at, at[1:], strict=False):
                s = shingle_set(flat[i:j], size)
                with np.errstate(over="ignore"):
                    mixed = (s.view(np.uint64) ^ (s.view(np.uint64) >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                    nodes.append((mixed.sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64))
                if whole:
                    parts.append(s)
                    continue
                maps.append(sketch(mixed))
                fps.append(fingerprint(mixed))
                if common is not None and len(common[0]):
                    k = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
                    s = s[np.argsort(np.where(common[0][k] == s, common[1][k], 0), kind="stable")]
                ns.append(len(s))
                parts.append(s[: len(s) - -(-NUM * len(s) // DEN) + 1] if len(s) else s)
            sizes = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            got = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            node = pa.array(np.array(nodes, np.int64))
            if whole:
                yield pa.RecordBatch.from_arrays([node, got], ["node", "set"])
            else:
                ends = np.concatenate(([0], np.cumsum([len(m) for m in maps]))).astype(np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *maps])))
                kept = [c for c in b.schema.names if c != "words"]
                out = [*(b.column(c) for c in kept), node, pa.array(np.array(ns, np.int32)), pa.array(np.array(fps, np.int64)), sketches, got]
                yield pa.RecordBatch.from_arrays(out, [*kept, "node", "n", "fp", "sketch", "prefix"])

    return run


def hashed_words(text: Column) -> Column:
    return F.transform(split_words(ascii_lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: F.xxhash64(w))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a sample of documents holds more than once, sorted, and their counts."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(step)) == 0).select(hashed_words(F.col("text")).alias("words"))
    hs = some.mapInArrow(_sets(size, None, True), "node long, set array<long>").select(F.explode("set").alias("h"))
    top = hs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()  # rows of Python would take the driver ten times the bytes
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def _kept(df: DataFrame) -> tuple[DataFrame, int]:
    """df on the executors' disks, and its rows. Its sources are written tables, so a lost part is computed again from them; unlike a written table it needs no commit of files."""
    df = df.persist(StorageLevel.DISK_ONLY)
    return df, df.count()


def _joined(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, so_far: DataFrame) -> DataFrame:
    """so_far (node, component), its components joined by those pairs (a, b) of nodes whose sets reach the similarity. Only the texts of pairs that sketches let pass are cut again."""
    light = classes.select("node", "n", "sketch")
    for c in "ab":
        pairs = pairs.join(light.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch")]), c)
    pairs = stored(pairs.where(_may_match()).select("a", "b"), "pairs")  # written, for the driver holds the plans of persisted tables within those of all that follow
    n = pairs.count()
    if not n:
        return so_far
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = nodes.join(classes.select("node", "key"), "node").select(F.col("key").alias("k"))
    texts = docs.join(broadcast_within(keys, 2 * n)[0], F.col("key") == F.col("k"), "left_semi").select(hashed_words(F.col("text")).alias("words"))
    sets = texts.mapInArrow(_sets(size, None, True), "node long, set array<long>").dropDuplicates(["node"]).persist(StorageLevel.DISK_ONLY)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    near = stored(both.where((NUM + DEN) * common >= NUM * (F.size("x") + F.size("y"))).select("a", "b"), "near")
    sets.unpersist()
    return components(near.unionByName(so_far.select(F.col("node").alias("a"), F.col("component").alias("b"))), n + so_far.count())


def drawn_together(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of nodes of classes (node, fp) that SimHash brings together: each with the smallest of its fingerprint, and those with one another within the distance."""
    own = stored(classes.groupBy("fp").agg(F.min("node").alias("m")), "fingerprints")
    equal = classes.join(own, "fp").where("node != m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    tiles = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return equal.unionByName(links(own.select(F.col("m").alias("node"), "fp"), bits, tiles)).distinct()


def near_copies(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, key (hash of the text), grp for every row of doc_id, text; grp is the same for what is linked by similarity.

    Any column may be null and doc_ids may repeat. Texts of fewer words than a shingle are one
    shingle; texts without words, and null, have the empty set and are equal to one another.
    """
    docs = in_small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("key"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, key long, node long, n int, fp long, sketch array<long>, prefix array<long>"
    prints = docs.select("doc_id", "key", hashed_words(F.col("text")).alias("words")).mapInArrow(_sets(size, common_shingles(docs, size), False), schema)
    prints = stored(prints, "prints")
    first = [F.first(c).alias(c) for c in ("fp", "sketch", "prefix")]
    classes = prints.groupBy("node").agg(F.first("n").alias("n"), F.min("key").alias("key"), *first)
    classes = stored(classes.coalesce(1 + plan_bytes(prints) // PART), "classes")
    at = classes.select("node", "n", F.explode("prefix").alias("shingle"))
    several, n = _kept(at.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("shingle"))
    shared = stored(at.join(broadcast_within(several, n)[0], "shingle"), "shared")
    several.unpersist()
    near = lambda x, y: DEN * F.least(x, y) >= NUM * F.greatest(x, y)

    so_far = _joined(drawn_together(classes.select("node", "fp")), docs, classes, size, docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("component")))

    def parted() -> DataFrame:
        return shared.join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))

    for turn in range(TURNS):  # in a large group most classes are linked to one of the few that its shingles draw, and need no more comparisons
        left = parted()
        drawn = F.min_by(F.struct("node", "n", "component"), F.xxhash64("node", "shingle", F.lit(turn)))
        several = left.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), drawn.alias("to")).where("low < high").select("shingle", "to")
        stars = left.join(several, "shingle").where((F.col("component") != F.col("to.component")) & near(F.col("n"), F.col("to.n")))
        stars = stars.select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b")).distinct()
        so_far = _joined(stars, docs, classes, size, so_far)
    open_ = parted()
    ends = open_.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high")
    ends = ends.select("shingle", (F.ceil(F.col("rows") / TILE) - 1).cast("int").alias("last"), (F.col("rows") > FEW).alias("many"))
    open_ = open_.join(ends, "shingle").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    open_ = stored(open_.select("node", "n", "shingle", "component", "chunk", "last", "many"), "open")
    # sketches are the most of what shuffles hold here, so those of half the size go along, and only where pairs would outnumber rows; _joined has them all
    halves = classes.select(F.col("node").alias("of"), F.lit(True).alias("many"), _folded(F.col("sketch")).alias("sketch"))
    open_ = open_.join(halves, (F.col("node") == F.col("of")) & (open_["many"] == halves["many"]), "left").select(open_["*"], "sketch")
    side = lambda to, x, y: open_.select("shingle", *[F.col(c).alias(f"{c}_{to}") for c in ("node", "n", "component", "sketch")], x.alias("x"), y.alias("y"))
    left = side("a", F.col("chunk"), F.explode(F.sequence("chunk", "last")))
    right = side("b", F.explode(F.sequence(F.lit(0), "chunk")), F.col("chunk"))
    on = [left[c] == right[c] for c in ("shingle", "x", "y")]
    on += [F.col("component_a") != F.col("component_b"), (left["x"] != left["y"]) | (F.col("node_a") < F.col("node_b")), _may_match()]
    rest = left.join(right, on).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    so_far = _joined(rest, docs, classes, size, so_far)
    return prints.select("doc_id", "key", "node").join(so_far, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("grp"))
