"""Katz backoff language model over words, scored where its counts are.

Good-Turing discounts apply to counts up to five. P(w | h) is the discounted ratio for a seen pair,
otherwise the backoff weight alpha(h) times P(w), the discounted unigram, whose left-over mass is the
unknown word's; alpha makes each history's probabilities sum to one exactly. A history whose every
pair occurs over five times has nothing to discount, so its ratios are taken over one count more,
and that count is what its unseen words get. Steps:

1. Word counts, dealt by word. Words that follow so many tokens that their pairs would fill
   a task are hot; there are at most 8 a part, and their pairs are dealt by both words.
2. Word counts go to the parts that need them, those of the histories that the word follows.
3. Pairs, each with its training count and the documents where it occurs, are dealt by history. A
   part merges its counts and writes the table of its histories (count, discounted types, mass of what was
   seen), with each document's share as far as it is known.
4. The tables are read back: counts of counts give the discounts, hot histories' rows are summed over
   the parts, alphas follow, and what waited for them is added. Shares are summed by row.

Blobs of sorted 64-bit hashes travel instead of rows, which is a third of the bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_part, even_keys, parts_for, repeatable, stored, table
from .repeats import Hasher, blobs, dealt, place, top, unpack

UP_TO = 5
FOLDS, HELD_OUT = 7, 2
GATHERED = 2_000_000
#: Bytes of input that a part stands for at most.
PART_BYTES = 32 << 20
#: A part is merged in so many slices of its histories, so that a task holds temporary columns of one slice at a time.
SLICES = 6


def raw(*cols: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as they are, byte by byte."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in cols]
    return zstandard.compress(b"".join(planes), 1)


def unraw(data: list[bytes], *kinds) -> list[np.ndarray]:
    got = [np.frombuffer(zstandard.decompress(d), np.uint8).reshape(len(kinds), 8, -1) for d in data]
    col = lambda i, k: np.concatenate([np.ascontiguousarray(g[i].T).view(k).ravel() for g in got])
    return [col(i, k) if got else np.zeros(0, k) for i, k in enumerate(kinds)]


class Texts(Hasher):
    """Word hashes of texts: words in ASCII lower case, then the end; and of each token's history."""

    def __init__(self):
        super().__init__()
        self.start, self.end = self.words([b" start"]), self.words([b" end"])

    def read(self, batches):
        """(row, in training, tokens, histories) of every row. Rows are numbered: the task in the upper bits, the place in it below."""
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for d, held, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), texts, strict=True):
                w = np.concatenate((self.words((t or b"").lower().split()), self.end))
                yield (row, 0 if d is None else d, 2 * (d is None) + held), not held, w, np.concatenate((self.start, w[:-1]))
                row += 1

    def gathered(self, batches):
        """Rows, and concatenated (row, training, token, history), of about GATHERED tokens at a time."""
        got, rows, n = [], [], 0
        for r, t, w, h in self.read(batches):
            got.append((np.full(len(w), r[0], np.int64), np.full(len(w), t), w, h))
            rows.append(r)
            n += len(w)
            if n >= GATHERED:
                yield rows, *[np.concatenate(c) for c in zip(*got, strict=True)]
                got, rows, n = [], [], 0
        if got:
            yield rows, *[np.concatenate(c) for c in zip(*got, strict=True)]


def steps(a: np.ndarray) -> np.ndarray:
    """Differences from one to the next, modulo 2**64: small in sorted stretches."""
    return np.diff(a, prepend=np.uint64(0))


def firsts(*cols: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def sums(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(a, at) if len(at) else a[:0]


def part_of(h: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    p = top(h, parts)
    spread = np.isin(h, hot)
    p[spread] = top(w[spread] ^ h[spread], parts)
    return p


def _frequent(parts: int):
    def go(batches):
        for *_, h in Texts().gathered(batches):
            key, n = np.unique(h, return_counts=True)
            many = n * 8 * parts >= len(h)
            cols = [np.append(key[many].view(np.int64), 0), np.append(n[many], 0), np.append(n[many] * 0, len(h))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["h", "n", "total"])

    return go


def _words(parts: int, hot: np.ndarray):
    def go(batches):
        for _, _, t, w, h in Texts().gathered(batches):
            p = part_of(h, w, hot, parts)
            order = np.lexsort((p, w))
            w, p, t = w[order], p[order], t[order].astype(np.int64)
            at = firsts(w, p)
            yield blobs(dealt(0, top(w[at], parts), parts, w[at], p[at], sums(t, at)))

    return go


#: What a part tells of its words: how many occur once, twice and so on, then tokens and types.
TOLD = UP_TO + 3


def _count_words(parts: int, hot: np.ndarray):
    """To each part that asked: its words and their counts (kind 0). What TOLD says (kind 1), and counts of hot words (kind 2)."""

    def go(t: pa.Table) -> pa.Table:
        w, p, n = unpack(t.column("data").to_pylist(), 3)
        order = np.lexsort((p, w))
        w, p, n = w[order], p[order], n[order]
        at = firsts(w)
        total = sums(n, at)
        of = np.repeat(total, np.diff(np.append(at, len(w))))
        pair = firsts(w, p)
        low = [int((total == k).sum()) for k in range(1, UP_TO + 2)]
        known = np.isin(w[at], hot)
        rows = dealt(0, p[pair], parts, w[pair], of[pair])
        rows.append((1, 0, raw(np.array([*low, total.sum(), (total > 0).sum()], np.int64))))
        if known.any():
            rows.append((2, 0, raw(w[at][known].view(np.int64), total[known])))
        return pa.Table.from_batches([blobs(rows)])

    return go


def discounts(n: dict[int, int]) -> np.ndarray:
    """d[r] for r up to UP_TO, from counts of counts; (r - 1/2)/r where Good-Turing gives none between 0 and 1."""
    d = np.ones(UP_TO + 1)
    last = (UP_TO + 1) * n.get(UP_TO + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, UP_TO + 1):
        g = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - last) / (1 - last) if n.get(r) and last < 1 else 0
        d[r] = g if 0 < g < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """Discounted unigram probabilities as a function of a word's count, from counts of counts, tokens and types."""

    def __init__(self, of_counts: dict[int, int], tokens: int, types: int):
        self.n, self.v, self.d = tokens, types, discounts(of_counts)
        low = {k: k * of_counts.get(k, 0) for k in range(1, UP_TO + 1)}
        used = tokens - sum(low.values()) + sum(float(self.d[k]) * x for k, x in low.items())
        self.total = tokens if used < tokens else tokens + 1  # if nothing was discounted, the unknown word gets one count
        self.unknown = (self.total - used) / self.total if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= UP_TO, self.d[np.minimum(c, UP_TO)], 1.0)
        return np.where(c > 0, d * c / max(self.total, 1), self.unknown)


def _pairs(parts: int, hot: np.ndarray):
    """A batch's pairs for each part with their rows, and to one part the list of the batch's rows."""

    def go(batches):
        for rows, d, t, w, h in Texts().gathered(batches):
            p = part_of(h, w, hot, parts)
            order = np.lexsort((w, h, p))
            d, t, w, h, p = d[order], t[order].astype(np.int64), w[order], h[order], p[order]
            at = firsts(p, h, w)
            n = np.diff(np.append(at, len(w)))
            cut = firsts(p)
            ends = np.append(cut[1:], len(p))
            types = np.searchsorted(at, np.append(cut, len(p)))
            train = sums(t, at)
            keys = even_keys(parts)
            packed = [raw(steps(h[at[a:b]]), steps(w[at[a:b]]), train[a:b], n[a:b]) for a, b in zip(types[:-1], types[1:], strict=True)]
            docs = [raw(d[i:j]) for i, j in zip(cut, ends, strict=True)]
            listed = raw(*np.array(rows, np.int64).T)
            to = np.append(keys[p[cut]], keys[place(np.array([rows[0][0]]), parts)])
            cols = [pa.array(to, pa.int32()), pa.array([*packed, None], pa.binary()), pa.array([*docs, None], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([None] * len(docs) + [listed], pa.binary())], ["part", "types", "docs", "rows"])

    return go


BINARY = ["hot", "histories", "shares", "unseen", "alone", "rows"]
MERGED = ", ".join(f"{c} binary" for c in BINARY) + ", of_counts array<long>"


def _merge(uni: Unigrams, hot: np.ndarray, hot_n: np.ndarray):
    """A part's histories (h, c(h), types counted 1..5, tokens of the rest, unigram mass of what was seen) and shares of rows."""

    def merged(h, w, train, n, to, docs, known, count, first):
        """One slice: statistics of histories, which are hot, counts of counts, shares added up by row (of `to`), (history, row) of
        unseen pairs, and of pairs seen after hot histories that have nothing to discount here."""
        order = np.lexsort((w, h))
        at = firsts(h[order], w[order])
        kind = np.empty(len(h), np.int64)
        kind[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        r = sums(train[order], at)
        h, w = h[order][at], w[order][at]
        c = count[np.searchsorted(known, w)] if len(w) else np.zeros(0, np.int64)
        p = uni.p(c)
        ctx = firsts(h)
        of = np.repeat(np.arange(len(ctx)), np.diff(np.append(ctx, len(h))))
        total = sums(r, ctx)
        spread = np.isin(h[ctx], hot)
        low = np.stack([np.bincount(of, r == k, len(ctx)) for k in range(1, UP_TO + 1)]) if len(h) else np.zeros((UP_TO, 0))
        rest, seen_mass = np.bincount(of, r * (r > UP_TO), len(ctx)), np.bincount(of, p * (r > 0), len(ctx))
        bare = low.sum(0) == 0  # nothing to discount: the unseen words share one count more
        whole = total + (bare & (total > 0))
        if len(hot):  # of hot histories other parts have pairs too, so that is settled later
            whole = np.where(spread, hot_n[np.searchsorted(hot, h[ctx]).clip(0, len(hot) - 1)], whole)
        with np.errstate(divide="ignore"):
            part = np.where(r > 0, np.log10(np.maximum(r, 1) / np.maximum(whole[of], 1)), np.log10(p))
            base = np.log10((c + 1) / (uni.n + uni.v + 1))
        occ = np.repeat(kind, n)
        ro, history = r[occ], of[occ]
        add = lambda v: np.bincount(to, v, docs)
        shares = [add(base[occ]), add(part[occ]), add(np.ones(len(to))), add(c[occ] > 0), *(add(ro == k) for k in range(1, UP_TO + 1))]
        late = (ro == 0) & (whole[history] > 0)
        odd = (ro > 0) & (spread & bare)[history]
        stats = [h[ctx].view(np.int64), whole.astype(np.int64), *low.astype(np.int64), rest.astype(np.int64), seen_mass]
        counts = [int((r == k).sum()) for k in range(1, UP_TO + 2)]
        return stats, spread, counts, shares, (history[late] + first, to[late]), (history[odd] + first, to[odd])

    def go(pairs: pa.Table, words: pa.Table) -> pa.Table:
        cols = [_one(x) for x in pairs.column("types").to_pylist() if x is not None]
        h, w, train, n = [np.concatenate(c) for c in zip(*cols, strict=True)] if cols else [np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64)]
        del cols
        (doc,) = unraw([x for x in pairs.column("docs").to_pylist() if x is not None], np.int64)
        listed = unraw([x for x in pairs.column("rows").to_pylist() if x is not None], np.int64, np.int64, np.int64)
        ids, doc = np.unique(doc, return_inverse=True)
        known, count = unpack(words.column("data").to_pylist(), 2)
        order = np.argsort(known)
        known, count = known[order], count[order]
        begin = np.cumsum(n) - n
        slice_of = (h >> np.uint64(5)) % np.uint64(SLICES)
        stats, spread, counts, shares, unseen, odd, first = [], [], np.zeros(UP_TO + 1, np.int64), None, [], [], 0
        for k in range(SLICES):
            own = np.flatnonzero(slice_of == k)
            rows = np.repeat(begin[own] - np.append(0, np.cumsum(n[own])[:-1]), n[own]) + np.arange(n[own].sum()) if len(own) else np.zeros(0, np.int64)
            s, hot_here, of_counts, sh, u, o = merged(h[own], w[own], train[own], n[own], doc[rows], len(ids), known, count, first)
            stats.append(s)
            spread.append(hot_here)
            counts += of_counts
            unseen.append(u)
            odd.append(o)
            shares = sh if shares is None else [a + b for a, b in zip(shares, sh, strict=True)]
            first += len(s[0])
        stats = [np.concatenate(c) for c in zip(*stats, strict=True)]
        both = lambda got: [np.concatenate(c).astype(np.int64) for c in zip(*got, strict=True)]
        hot_rows = np.concatenate(spread)
        shares = raw(ids, *shares[:2], *(s.round().astype(np.int64) for s in shares[2:]))
        row = [raw(*(s[hot_rows] for s in stats)), raw(*stats), shares, raw(*both(unseen)), raw(*both(odd)), raw(*listed)]
        return pa.table([*(pa.array([x], pa.binary()) for x in row), pa.array([counts.tolist()], pa.list_(pa.int64()))], [*BINARY, "of_counts"])

    return go


def _one(data: bytes) -> list[np.ndarray]:
    h, w, train, n = unraw([data], np.uint64, np.uint64, np.int64, np.int64)
    return [np.cumsum(h, dtype=np.uint64), np.cumsum(w, dtype=np.uint64), train, n]


STATS = (np.int64, np.int64, *[np.int64] * UP_TO, np.int64, np.float64)
STAT_NAMES = ["h", "whole", *(f"low{k}" for k in range(1, UP_TO + 1)), "rest", "seen"]


def _hot_rows(batches):
    """The parts' statistics of hot histories as rows."""
    for b in batches:
        cols = unraw(b.column("hot").to_pylist(), *STATS)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), STAT_NAMES)


def alphas(stats: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """Backoff weight of each history: the mass its seen words leave, over the unigram mass of its unseen ones."""
    _, whole, *low, rest, seen = stats
    used = rest + sum(k * d[k] * low[k - 1] for k in range(1, UP_TO + 1))
    left = np.maximum(1 - used / np.maximum(whole, 1), 1 / (np.maximum(whole, 1) + 1.0) * (used >= whole))
    return np.where(whole > 0, left / np.maximum(1 - seen, 1e-300), 1.0)


def _finish(d: np.ndarray, hot: list[np.ndarray], buckets: int):
    """Reads a part's tables back: discounts and alphas are added to the shares, which go to the buckets of their rows.

    hot: sorted hot histories, their alphas, and what a pair seen after them is short of if nothing of theirs is discounted."""

    def go(batches):
        keys = even_keys(buckets)
        for b in batches:
            for i in range(b.num_rows):
                stats = unraw([b.column("histories")[i].as_py()], *STATS)
                alpha, short = alphas(stats, d), np.zeros(len(stats[0]))
                if len(hot[0]):
                    at = np.searchsorted(hot[0], stats[0]).clip(0, len(hot[0]) - 1)
                    is_hot = hot[0][at] == stats[0]
                    alpha, short = np.where(is_hot, hot[1][at], alpha), np.where(is_hot, hot[2][at], 0.0)
                ids, base, score, n, known, *low = unraw([b.column("shares")[i].as_py()], np.int64, np.float64, np.float64, *[np.int64] * (2 + UP_TO))
                score = score + sum(np.log10(d[k]) * low[k - 1] for k in range(1, UP_TO + 1))
                for name, value in (("unseen", np.log10(alpha)), ("alone", short)):
                    x, to = unraw([b.column(name)[i].as_py()], np.int64, np.int64)
                    score = score + np.bincount(to, value[x], len(ids))
                listed = unraw([b.column("rows")[i].as_py()], np.int64, np.int64, np.int64)
                for kind, cols in enumerate(((ids, base, score, n, known), listed)):
                    where = place(cols[0], buckets)
                    order = np.argsort(where, kind="stable")
                    cut = firsts(where[order])
                    for a, z in zip(cut, np.append(cut[1:], len(where))[: len(cut)], strict=True):
                        yield blobs([(kind, int(keys[where[order[a]]]), raw(*(c[order[a:z]] for c in cols)))])

    return go


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum(n_train: int):
    def go(t: pa.Table) -> pa.Table:
        kinds, data = t.column("kind").to_pylist(), t.column("data").to_pylist()
        ids, base, score, n, known = unraw([x for k, x in zip(kinds, data, strict=True) if k == 0], np.int64, np.float64, np.float64, np.int64, np.int64)
        row, doc, flags = unraw([x for k, x in zip(kinds, data, strict=True) if k == 1], np.int64, np.int64, np.int64)
        order = np.argsort(row)
        row, doc, flags = row[order], doc[order], flags[order]
        to = np.searchsorted(row, ids)
        add = lambda v: np.bincount(to, v, len(row))
        whole = lambda v: pa.array(add(v).round().astype(np.int64))
        cols = [pa.array(doc, mask=flags >= 2), pa.array(flags % 2 == 1), whole(n), whole(known), pa.array(np.full(len(row), n_train, np.int64)), pa.array(add(base)), pa.array(add(score))]
        return pa.table(cols, [c.split()[0] for c in RESULT.split(", ")])

    return go


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT modulo FOLDS; of no text if it is null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text, end included).

    One row for each row of docs, whether its doc_id is null, repeated or its own, and repeated rows are scored alike. Learns from
    the rows whose crc32(doc_id as text) mod 7 is not 2 (rows without doc_id train) and scores all. A null text is empty: its one
    token is the end. Texts of any length are whole, cut nowhere. No rows: no rows. Other columns are ignored. Words whose counts
    tie are treated alike, so ties need no rule.
    """
    parts = parts_for(docs, PART_BYTES, 200)
    docs = repeatable(docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id").cast("long")).alias("held_out")))
    often = docs.mapInArrow(_frequent(parts), "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    often = stored(often, "frequent")
    tokens = often.agg(F.sum("total")).first()[0] or 0
    most = often.where((F.col("n") > 0) & (F.col("n") * 8 * parts >= tokens)).select("h").collect()  # at most 8 a part
    hot = np.sort(np.array([r.h for r in most], np.int64).view(np.uint64))
    blob = "kind int, part int, data binary"
    words = stored(by_part(docs.mapInArrow(_words(parts, hot), blob), parts).applyInArrow(_count_words(parts, hot), blob), "words")
    told = [unraw([bytes(r.data)], np.int64)[0] for r in words.where("kind = 1").select("data").collect()]  # a few numbers from each part
    *low, n, v = np.sum([np.zeros(TOLD, np.int64), *told], axis=0).tolist()
    uni = Unigrams({k + 1: x for k, x in enumerate(low)}, n, v)
    h, c = unraw([bytes(r.data) for r in words.where("kind = 2").select("data").collect()], np.int64, np.int64)  # hot words only
    have = dict(zip(h.tolist(), c.tolist(), strict=True))
    hot_n = np.array([have.get(x, 0) for x in hot.view(np.int64).tolist()], np.int64)
    start = Texts().start[0]
    if start in hot:  # the start is no token: its count is that of training texts
        hot_n[np.searchsorted(hot, start)] = docs.where("not held_out").count()
    pairs = docs.mapInArrow(_pairs(parts, hot), "part int, types binary, docs binary, rows binary")
    merged = by_part(pairs, parts).cogroup(by_part(words.where("kind = 0"), parts)).applyInArrow(_merge(uni, hot, hot_n), MERGED)
    merged = stored(merged, "histories", compression="none")
    n_of = merged.select(*[F.sum(F.get("of_counts", F.lit(k))) for k in range(UP_TO + 1)]).first()
    d = discounts({k + 1: x or 0 for k, x in enumerate(n_of)})
    sides = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    if len(hot):
        schema = ", ".join(f"{c} {'double' if c == 'seen' else 'long'}" for c in STAT_NAMES)
        rows = merged.select("hot").mapInArrow(_hot_rows, schema).groupBy("h").agg(F.max("whole").alias("whole"), *[F.sum(c).alias(c) for c in STAT_NAMES[2:]])
        rows = sorted(rows.collect())  # at most 8 a part
        stats = [np.array([r[i] for r in rows]) for i in range(len(STAT_NAMES))]
        bare = (sum(stats[2:-2]) == 0) & (stats[1] > 0)
        sides = [stats[0], alphas(stats, d), np.where(bare, np.log10(stats[1] / (stats[1] + 1.0), where=bare, out=np.zeros(len(bare))), 0.0)]
    shares = merged.select("histories", "shares", "unseen", "alone", "rows").mapInArrow(_finish(d, sides, parts), blob)
    return by_part(shares, parts).applyInArrow(_sum(uni.n), RESULT)


def op4_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
