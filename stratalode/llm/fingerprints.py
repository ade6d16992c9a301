"""I-Match document fingerprints.

A term is kept if its document frequency lies in a band; the band is held exactly. A document's sorted distinct
kept terms are hashed once as they are and once through each of several fixed randomised subsets of the lexicon:
every signature covers all kept terms of the document that the subset has. The subsets, the same for all documents, have
halving densities, from every second term to one in 2**LEVELS, each density CHAINS times over with
other terms. Dense subsets tell exact copies, sparse ones leave long documents few terms each, so that an edit to
part of a text leaves the signatures that hold none of the edited terms unchanged.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NON_WORD, ascii_lower, even_key, parts_for, split_words, table

CHAINS, LEVELS = 5, 12
#: Bytes of input that a block of neighbouring documents stands for at most.
BLOCK_BYTES = 16 << 20


def term_hashes(text: Column) -> Column:
    words = split_words(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, most_share: float = 0.1, least_share: float = 0.001, least: int = 2) -> list[int]:
    """Hashes of the band's terms: those of least_share to most_share of the documents.

    least_share bounds them, however large the corpus: document frequencies add up to documents times
    mean distinct terms, so at most mean / least_share terms can reach it.
    """
    n = docs.count()
    seen = docs.select(F.explode_outer(F.array_distinct(split_words(ascii_lower(F.col("text")), NON_WORD))).alias("w"))
    df = seen.where("w is not null").groupBy(F.xxhash64("w").alias("h")).count()
    band = df.where((F.col("count") >= max(least, n * least_share)) & (F.col("count") <= max(least, n * most_share)))
    return sorted(r.h for r in band.select("h").toLocalIterator())


def in_band(terms: Column, band: list[int]) -> Column:
    """The terms that are in the band, which is a literal table of cells of about two hashes."""
    cells: list[list[int]] = [[] for _ in range(1 << max(0, (len(band) // 2).bit_length()))]
    for h in band:
        cells[h & (len(cells) - 1)].append(h)
    lookup = F.from_json(F.lit(json.dumps(cells)), "array<array<bigint>>")
    return F.filter(terms, lambda h: F.array_contains(F.get(lookup, h.bitwiseAND(F.lit(len(cells) - 1)).cast("int")), h))


def sign(terms: Column) -> Column:
    """32 bits over all the terms; null if there are none."""
    return F.when(F.size(terms) > 0, F.pmod(F.xxhash64(terms), F.lit(1 << 32)))


def signatures(terms: Column) -> Column:
    """A signature of the sorted terms for each subset: all, then LEVELS ever sparser ones in each of the chains. Bits of a term's hash say which have it."""

    def chain(at: int) -> Column:
        start = F.struct(F.filter(terms, lambda h: F.getbit(h, F.lit(at)) == 0).alias("left"), F.array().cast("array<bigint>").alias("signs"))

        def thinner(s: Column, i: Column) -> Column:
            left = F.filter(s["left"], lambda h: F.getbit(h, F.least(F.lit(at) + i, F.lit(63))) == 0)
            return F.struct(left.alias("left"), F.array_append(s["signs"], sign(s["left"])).alias("signs"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, thinner, lambda s: s["signs"])

    return F.concat(F.array(sign(terms)), *[chain(LEVELS * j) for j in range(CHAINS)])


def likeness(a: str, b: str) -> Column:
    """Share of the subsets in use by either document whose signatures agree; 1 if neither has a term."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def add_fingerprint(df: DataFrame, text: str, band: list[int], to: str) -> DataFrame:
    """Adds the array of signatures of a text column. Documents with no term in the band are hashed over all their terms."""
    every, kept = f"__all_{to}", f"__band_{to}"
    df = df.withColumn(every, term_hashes(F.col(text))).withColumn(kept, in_band(F.col(every), band))
    df = df.withColumn(kept, F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(every)))
    return df.withColumn(to, signatures(F.col(kept))).drop(every, kept)


def as_text(signs: str) -> Column:
    """Eight hexadecimal digits a signature, dashes for a subset without terms."""
    return F.array_join(F.transform(F.col(signs), lambda s: F.coalesce(F.lpad(F.lower(F.hex(s)), 8, "0"), F.lit("-" * 8))), "")


def _long_list(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def block_of(cuts: list[int], sizes: list[int]) -> Column:
    """The block of a row of doc_id, key: how many cuts are at or below its doc_id, found in two steps. A block of which sizes has
    more than one is split by key; the first is that of rows without doc_id."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda some: F.size(F.filter(some, lambda c: c <= F.col("doc_id")))
    if cuts:
        group = below(_long_list([g[0] for g in groups], "array<bigint>"))
        inside = F.when(group == 0, 0).otherwise((group - 1) * step + below(F.get(_long_list(groups, "array<array<bigint>>"), F.greatest(group - 1, F.lit(0)))))
    else:
        inside = F.lit(0)
    block = F.when(F.col("doc_id").isNull(), 0).otherwise(inside + 1)
    at = F.get(_long_list([0, *accumulate(sizes)], "array<int>"), block)
    return (at + F.shiftright(F.shiftright("key", 32) * F.get(_long_list(sizes, "array<int>"), block), 31)).cast("int")


def with_next(docs: DataFrame, blocks: int) -> tuple[DataFrame, Window]:
    """doc_id, text, key (hash of the text) and part, each part also holding the row that follows its last one, marked `guest`.

    Parts are ranges of doc_id with ends at its quantiles. A doc_id that fills more than one range, and rows without
    doc_id, which come first, are split by key. So lead() finds every next row within its part, and no task sees more than a range.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.shiftrightunsigned(F.xxhash64("text"), 1))
    shares = [i / blocks for i in range(1, blocks)] or [0.5]
    ends, n, known = docs.select(F.percentile_approx("doc_id", shares, 20 * blocks), F.count(F.lit(1)), F.count("doc_id")).first()
    ends = (ends or []) if blocks > 1 else []
    often = {e: ends.count(e) for e, f in zip(ends, ends[1:], strict=False) if e == f}  # such a doc_id has a block of its own
    cuts = sorted({*ends, *(e + 1 for e in often)})
    sizes = [max(1, -(-(n - known) * blocks // max(n, 1))), 1, *(often.get(c, 0) + 1 for c in cuts)]
    total = sum(sizes)
    placed = docs.withColumn("block", block_of(cuts, sizes))
    firsts = sorted((r.block, r.f.doc_id, r.f.key) for r in placed.groupBy("block").agg(F.min(F.struct("doc_id", "key")).alias("f")).collect())  # one row a block
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "key")
    own = placed.withColumn("guest", F.lit(0))
    if firsts:
        follow = [{"d": d, "k": k, "block": firsts[i - 1][0]} for i, (_, d, k) in enumerate(firsts)]
        heads = docs.sparkSession.range(1).select(F.inline(_long_list(follow, "array<struct<d:bigint,k:bigint,block:int>>")))
        guests = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))  # as many rows as blocks
        guests = guests.dropDuplicates(["block"]).select("doc_id", "text", "key", "block", F.lit(1).alias("guest"))
        own = own.unionByName(guests)
    return own.withColumn("part", even_key(F.col("block"), total)).repartition(total, "part"), order


def fingerprint_edits(docs: DataFrame, blocks: int | None = None, band: list[int] | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the start of the next document.

    One row for each row of docs. A null text counts as empty. Rows with one doc_id are taken in order of their texts'
    hashes, repeated rows one after another; rows without doc_id come first; the row after the last is the first. Texts of any
    length are whole. No rows: no rows. Other columns of docs, whatever their names, are ignored.
    """
    blocks = blocks or parts_for(docs, BLOCK_BYTES, 512)
    docs = docs.select("doc_id", "text")
    band = band if band is not None else lexicon(docs)
    both, order = with_next(docs, blocks)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    df = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("next_text", F.lead("text").over(order))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter)))
    df = df.drop("next_text")
    df = add_fingerprint(df, "text", band, "own")
    df = add_fingerprint(df, "edited", band, "after")
    df = df.select("doc_id", "part", "guest", "key", "n_chars", "own", "after", F.sha2("edited", 256).alias("edited_sha256"))
    df = df.withColumn("next_own", F.lead("own").over(order)).where("guest = 0")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("after").alias("edited_fingerprint"),
        likeness("own", "after").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )


def op1_document_fingerprints(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))
