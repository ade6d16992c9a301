"""Benchmark decontamination as a prefix-filtered set join.

Every window of a benchmark item is a set of word shingles. Shingles are ordered by how rare they
are in the corpus. A window must occur whole, so one shingle, its rarest, is a sufficient prefix:
documents are joined on those shingles alone. The shingle's offset in its window then fixes where
the window would begin in the document (positional bound) and end (length bound), and the words
there are compared with the window's one by one.

Windows are broadcast, at most MOST at a time: a larger benchmark is taken in slices, each a pass over the
texts, so what is broadcast has one bound at every size and texts are never shuffled. Whether and what a text
holds depends on the text alone, so rows are told apart by two hashes of it, never by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, split_words, stored, table

SHINGLE = 3
NON_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows that are broadcast together.
MOST = 1_000_000
KEY = ["k1", "k2"]


def text_words(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD)


def text_keys(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def shingle_at(words: str, at: Column, size: int) -> Column:
    """Hash of the `size` words from 0-based position `at`."""
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(size)])


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """window (its words, space-joined), need (the array), length, items holding it. Items without words have none."""
    words = items.select("item_id", text_words(F.col("text")).alias("words")).where("size(words) > 0")
    n = F.least(F.size("words"), F.lit(width))
    cut = words.withColumn("length", n).select("item_id", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("s"))
    cut = cut.select("item_id", F.col("length").cast("int"), F.slice("words", F.col("s"), F.col("length")).alias("need"))
    window = F.array_join("need", " ").alias("window")
    return cut.groupBy(window).agg(F.first("need").alias("need"), F.first("length").alias("length"), F.collect_set("item_id").alias("items"))


def positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Keys, words, pos and hash of the shingles of each size at every position of every text."""
    words = docs.select(*KEY, text_words(F.col("text")).alias("words"))
    at = words.select(*KEY, "words", F.posexplode_outer("words").alias("pos", "w"))  # _outer: an inferred filter would split each text twice
    fits = lambda k: F.col("pos") <= F.size("words") - k
    if len(sizes) == 1:
        return at.where(fits(sizes[0])).select(*KEY, "words", "pos", shingle_at("words", F.col("pos"), sizes[0]).alias("shingle"))
    every = F.array(*[F.when(fits(k), shingle_at("words", F.col("pos"), k)) for k in sizes])
    # no array_compact: without generated code, each row would take a copy of all the text's words before the join drops it
    return at.select(*KEY, "words", "pos", F.explode_outer(every).alias("shingle")).where("shingle is not null")


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Keys, window, start, length of every occurrence of a window of docs (KEY, text)."""
    k = F.least(F.col("length"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in windows.select(k.alias("k")).distinct().collect())  # 1 to SHINGLE
    at = windows.select("window", "need", "length", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("offset"))
    shingle = reduce(lambda x, i: F.when(F.col("k") == i, shingle_at("need", F.col("offset"), i)).otherwise(x), sizes, F.lit(None).cast("long"))
    at = at.withColumn("shingle", shingle)
    seen = positions(docs, sizes).select("shingle").join(F.broadcast(at.select("shingle").distinct()), "shingle").groupBy("shingle").count()
    ranked = at.join(seen, "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    prefix = F.min_by(F.struct("shingle", "offset", "need", "length"), F.struct("count", "shingle", "offset"))
    prefix = ranked.groupBy("window").agg(prefix.alias("p"), F.min("count").alias("least")).where("least > 0").select("window", "p.*")
    start = F.col("pos") - F.col("offset")
    got = positions(docs, sizes).join(F.broadcast(prefix), "shingle").where((start >= 0) & (start + F.col("length") <= F.size("words")))
    got = got.where(F.slice("words", start + 1, F.col("length")) == F.col("need"))
    return got.select(*KEY, "window", start.alias("start"), "length")


def contaminated(docs: DataFrame, items: DataFrame, width: int, most: int = MOST) -> DataFrame | None:
    """k1, k2, n_hit, item_ids for each text of docs (KEY, text) that holds a window; None if no item has words."""
    windows = stored(item_windows(items.select("item_id", "text"), width), "windows")
    n = windows.count()
    if not n:
        return None
    slices = -(-n // most)
    part = [windows.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == i) for i in range(slices)] if slices > 1 else [windows]
    got = reduce(DataFrame.unionByName, [hits(docs, w) for w in part])
    per = got.groupBy(*KEY).agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("window").alias("ws"))
    per = stored(per, "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    which = per.select(*KEY, F.explode("ws").alias("window")).join(windows.select("window", "items"), "window")
    found = which.select(*KEY, F.explode("items").alias("item")).groupBy(*KEY).agg(F.collect_set("item").alias("item_ids"))
    return per.select(*KEY, covered.cast("long").alias("n_hit")).join(found, KEY)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated, item_ids.

    doc_ids may be null or repeated and rows may be: each row's result is that of its own text. A null or wordless text has no
    hits. Texts of any length are read whole. Windows that several items share count for each of them; of shingles that are
    equally rare the one with the smaller hash, then offset, is joined, which changes no result. Items without words are never
    found; without items, or without rows, nothing is. Other columns, whatever their names, are ignored.
    """
    kind = dict(items.dtypes)["item_id"]
    docs = docs.select("doc_id", "text", *text_keys())
    n_words = F.size(split_words(F.coalesce("text", F.lit("")), NON_WORD_CASED))  # their number is the same in either case
    words = docs.select("doc_id", *KEY, n_words.cast("long").alias("n_words"))
    per = contaminated(docs.select(*KEY, "text"), items, width, most)
    if per is None:
        df = words.withColumns({"n_hit": F.lit(None).cast("long"), "item_ids": F.array().cast(f"array<{kind}>")})
    else:
        df = words.join(per, KEY, "left")
    ids, n_hit = F.coalesce(F.col("item_ids"), F.array().cast(f"array<{kind}>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    digest = F.sha2(F.array_join(F.sort_array(ids.cast("array<string>")), ","), 256)
    return df.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), digest.alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.sort_array(ids).alias("item_ids"),
    )


def op3_benchmark_decontamination(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("item_ids")


def stage(spark, docs, sf_dir, width: int = 10):
    """Drops the documents that hold a window of a benchmark item, and keeps every other row: null and repeated ids, repeated rows, rows without text."""
    bad = contaminated(docs.select(*text_keys(), "text"), table(spark, sf_dir, "benchmark"), width)
    if bad is None:
        return docs
    bad = stored(bad.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "contaminated")
    return docs.join(bad, (F.xxhash64("text") == F.col("__k1")) & (F.xxhash64(F.lit(1), "text") == F.col("__k2")), "left_anti")
