"""Source divergence audit: how far each source's use of terms lies from that of the other sources of its language, and by which terms.

One pass over the texts counts terms by (lang, source) and the documents that hold them. Terms in enough documents of their language
are kept. They are dealt to tasks in ranges by UTF-8, so that every task has a sorted dictionary: searchsorted gives the ids, bincount the
counts of all sources as dense vectors of a chunk, and equal values rank by id. A chunk's sums and first terms leave the task; sums over chunks follow.

All numbers are integers and exact (counts below 2^53). The work on pairs is sources^2 x terms by language, and every pair of sources of
a language is a row of the result; the table of groups (lang, source), of which there are no more than the root of that, is sent to all tasks.

Results at the edges. Null lang, source or text is the empty string. A text without terms still gives its group. A language without
kept terms gives pairs of value 0 and no terms. Every row is a document, repeated or not, whatever its id. Equal values rank by UTF-8.
A text is cut whole, however long. No documents give no rows; columns other than text, lang and source are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow_text import numbered, slices, translated, words
from .common import stored, table

LEAST_DOCUMENTS, TOP, SCALE, PRIOR = 10, 10, 1_000_000_000, 2
#: Rows that a task holds before it hands them on, counts of a dense chunk, rows of a range of terms, sides of a matrix of sums.
HELD, DENSE, RANGE, SIDE = 500_000, 2_000_000, 200_000, 2048
#: Letters in lower case, whatever separates terms as a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KEYS = ("lang", "source", "term")


def _summed(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(list(KEYS), use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select([*KEYS, "n_sum", "docs_sum"]).rename_columns([*KEYS, "n", "docs"])


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one stretch of rows. The empty term stands for the group itself."""
    flat, each = words(translated(batch.column("text"), TERM_BYTES))
    ids, terms = numbered(flat)
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    number = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first_row, of = np.unique(number(lang) * len(source.dictionary) + number(source), return_index=True, return_inverse=True)
    wide = max(1, len(terms))
    in_doc, n = np.unique(np.repeat(np.arange(len(each)), each) * wide + ids, return_counts=True)
    in_group, where = np.unique(of[in_doc // wide] * wide + in_doc % wide, return_inverse=True)
    none = np.zeros(len(first_row), np.int64)
    sums = np.r_[np.bincount(where, n, len(in_group)).astype(np.int64), none]
    held_by = np.r_[np.bincount(where, minlength=len(in_group)).astype(np.int64), none]
    row = pa.array(np.r_[first_row[in_group // wide], first_row])
    term = pa.concat_arrays([terms.take(pa.array(in_group % wide)), pa.array([""] * len(first_row), pa.string())])
    return pa.table([batch.column("lang").take(row), batch.column("source").take(row), term, sums, held_by], [*KEYS, "n", "docs"])


def _count(batches):
    held: list[pa.Table] = []
    for b in batches:
        for s in slices(b):
            held.append(_counted(s))
            if sum(t.num_rows for t in held) > HELD or sum(t.nbytes for t in held) > 64 << 20:
                held = [_summed(held)]
                if held[0].num_rows > HELD // 2 or held[0].nbytes > 32 << 20:
                    yield from held.pop().to_batches(max_chunksize=50_000)
    if held:
        yield from _summed(held).to_batches(max_chunksize=50_000)


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), three digits at a time, so that nothing exceeds 64 bits."""
    whole, rest = np.divmod(count + PRIOR, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _chunks(groups: dict[str, tuple[list[str], list[int], int]], top: int):
    """groups: of each language its sources in order, their sums of counts, and the number of kept terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def rows(lang: str, part: str, sources: list[str], of: np.ndarray, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(sources, pa.string()).take(pa.array(of)), pa.array([part] * n, pa.string()), items, pa.array(values)], schema=schema)

    def pairs(lang: str, sources: list[str], i: int, values: np.ndarray):
        """Values of source i with all later ones, in both directions."""
        later = np.arange(i + 1, len(sources))
        of, item = np.r_[np.full(len(later), i), later], np.r_[later, np.full(len(later), i)]
        return rows(lang, "pair", sources, of, pa.array(sources, pa.string()).take(pa.array(item)), np.r_[values, values])

    def chunk(lang: str, dictionary: np.ndarray, terms: np.ndarray, source: np.ndarray, n: np.ndarray, sums: np.ndarray | None):
        sources, totals, kept = groups[lang]
        ids, wide = np.searchsorted(dictionary, terms), len(dictionary)
        counts = np.bincount(source * wide + ids, n, len(sources) * wide).astype(np.int64).reshape(len(sources), wide)
        p = np.stack([shares(c, t + PRIOR * kept) for c, t in zip(counts, totals, strict=True)])
        q = shares(counts.sum(0), sum(totals) + PRIOR * kept)
        for i in range(len(sources)):
            f = np.where((counts[i] > 0) & (p[i] > q), apart(p[i], q), -1)
            best = np.argsort(-f, kind="stable")[:top]
            best = best[f[best] >= 0]
            if len(best):
                yield rows(lang, "term", sources, np.full(len(best), i), pa.array(dictionary[best].tolist(), pa.binary()).cast(pa.string()), f[best])
            if i + 1 < len(sources):
                step = max(1, DENSE // wide)
                with_later = np.concatenate([apart(p[i], p[at : at + step]).sum(1) for at in range(i + 1, len(sources), step)])
                if sums is None:
                    yield pairs(lang, sources, i, with_later)
                else:
                    sums[i, i + 1 :] += with_later

    def run(batches):
        lang, held, sums = None, [], None

        def flush(keep_last: bool):
            nonlocal held
            if not held:
                return
            terms, source, n = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
            end = first[-1] if keep_last else len(terms)
            held = [(terms[end:], source[end:], n[end:])] if end < len(terms) else []
            if end:
                yield from chunk(lang, terms[first[first < end]], terms[:end], source[:end], n[:end], sums)

        def ended():
            yield from flush(False)
            if sums is not None:
                for i in range(len(sums) - 1):
                    yield pairs(lang, groups[lang][0], i, sums[i, i + 1 :])

        for b in batches:
            langs = b.column("lang").dictionary_encode()
            at = langs.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), b.num_rows]
            for x, y in itertools.pairwise(cuts):
                now = langs.dictionary[int(at[x])].as_py() if x < y else lang
                if now != lang:
                    if lang is not None:
                        yield from ended()
                    lang, sources = now, groups[now][0]
                    sums = np.zeros((len(sources),) * 2, np.int64) if len(sources) <= SIDE else None
                step = max(1, DENSE // len(groups[lang][0])) if x < y else 1
                for part in (b.slice(i, min(step, y - i)) for i in range(x, y, step)):
                    terms = np.array([*part.column("term").cast(pa.binary()).to_pylist(), None], object)[:-1]
                    source = pc.index_in(part.column("source"), pa.array(groups[lang][0], pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
                    held.append((terms, source, part.column("n").to_numpy(zero_copy_only=False)))
                    if sum(len(h[0]) for h in held) >= step:
                        yield from flush(True)
        if lang is not None:
            yield from ended()

    return run


def divergence(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the others by divergence (part pair), and its `top` terms (part term)."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "terms")
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term <> ''").withColumns({"all": F.sum("docs").over(of_term), "one": (F.min("source").over(of_term) == F.col("source")).cast("long")}).where(F.col("all") >= least)
    kept = stored(kept.select(*KEYS, "n", "one"), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("one").alias("one"))
    found = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").orderBy("lang", "source").collect()
    groups: dict[str, tuple[list[str], list[int], int]] = {}
    for lang, rows in itertools.groupby(found, lambda r: r.lang):
        own = list(rows)
        groups[lang] = [r.source for r in own], [r.n or 0 for r in own], sum(r.one or 0 for r in own)
    parts = max(-(-kept.count() // RANGE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept.select(*KEYS, "n").repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    shape = "lang string, source string, part string, item string, value long"
    sums = dealt.mapInArrow(_chunks(groups, top), shape).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = docs.sparkSession.createDataFrame([(lang, s) for lang, (sources, _, v) in groups.items() if not v for s in sources], "lang string, source string")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.unionByName(zero).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of `documents`, by language."""
    return divergence(table(spark, sf_dir, "documents"))
