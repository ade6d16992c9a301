"""Periodic runs of words: stretches that repeat with a smallest period at least four times over.

The method is Kolpakov and Kucherov's. A suffix automaton gives the factorisation of Lempel and Ziv: each factor is the longest
stretch that began earlier, or one new word. Runs that cross or touch a boundary of factors are found from there by longest common
extensions (Main). Every other run lies strictly inside a factor and is copied from the factor's earlier occurrence.

A filter over whole batches comes first. In a run of at least six words and four periods every four words running occur twice or more, so
stretches between four-word sequences that occur once hold no run; the filter is repeated within what is left. It may keep too
much, never too little. Time is linear in the words; memory is about half a kilobyte a word of the longest stretch that is left.

Results at the edges. A null or empty text has no words and no runs, and the hashes are those of the empty string. Texts are read whole.
Of runs that tie for the longest the first start counts, then the smaller period. Every row is judged by itself, so that repeated rows
give equal results; without a doc_id, or with one that repeats, the row is kept as it is. Columns of the input other than its own are kept by runs_of(); if they
are named as one of its results they are replaced. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import numbered, slices, words
from .common import table

LEAST, TIMES = 6, 4
#: Words whose sequences the filter counts. In a run every one occurs twice: a run of q has max(6, 4q) - 3 of them, so 3 for q = 1, 5 for 2, 4q - 3 for more.
GRAM = 4
ROUNDS, COUNTERS = 6, 1 << 22
SHAPE = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def factors(s: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of every factor, from the suffix automaton of s."""
    nxt: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(s):
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 < size[q]:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                link[q] = copy
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                q = copy
            link[cur] = q
        last = cur
    b, n = 0, len(s)
    while b < n:
        state, e = 0, b
        while e < n and first[to := nxt[state][s[e]]] < e:
            state, e = to, e + 1
        yield (b, e - b, first[state] - (e - b) + 1) if e > b else (b, 1, -1)
        b = max(e, b + 1)


def prefixes(s: list[int]) -> list[int]:
    """For each place, how far what stands there agrees with the start of s."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_boundary(s: list[int], b: int, before: int, after: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that cross or touch place b and end within the factor of `after` words that begins there.

    What a run of period q shares with the factor of `before` words in front of b is less than one period longer than that factor, or the
    factor would have been longer. With four periods or more it follows that 3q < before + after.
    """
    most, n, end = (before + after - 1) // 3, len(s), b + after
    if most < 1 or before + after < 4:
        return
    low = max(0, b - before - most - 1)
    left, right = s[low:b][::-1], s[b:end]
    forward = min(most, after)
    back = min(most, b - low)
    ahead = prefixes(right)
    behind = prefixes(left)
    to_left = prefixes(left + [-1] + s[low : b + forward][::-1])
    to_right = prefixes(right + [-1] + s[b - back : end])
    spans = [(b - to_left[len(left) + 1 + forward - q], b + q + (ahead[q] if q < after else 0), q) for q in range(1, forward + 1)]
    spans += [(b - q - (behind[q] if q < len(left) else 0), b + to_right[after + 1 + back - q], q) for q in range(1, back + 1)]
    for i, j, q in spans:
        if j - i < max(LEAST, TIMES * q):
            continue
        if i == low and i > 0 and s[i - 1] == s[i - 1 + q] or j == end and j < n and s[j] == s[j - q]:
            continue  # it goes on, and is found at another boundary
        yield i, j, q


def runs(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of at least LEAST words and TIMES periods, by start."""
    n = len(s)
    at: list[dict[int, int] | None] = [None] * (n + 1)

    def add(i: int, j: int, q: int) -> None:
        if at[i] is None:
            at[i] = {}
        at[i][j] = min(q, at[i].get(j, q))

    before = 0
    for b, size, source in factors(s):
        for r in _at_boundary(s, b, before, size):
            add(*r)
        if source >= 0:
            by, end = b - source, b + size
            for i in range(b + 1, end - LEAST):
                if at[i - by]:
                    for j, q in tuple(at[i - by].items()):
                        if j + by < end:
                            add(i, j + by, q)
        before = size
    for r in _at_boundary(s, n, before, 0):
        add(*r)
    return [(i, j, q) for i, x in enumerate(at) if x for j, q in sorted(x.items())]


def may_hold_runs(ids: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of a batch's words outside of which no run lies. row: the text of each word."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = (key + ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    pos = np.flatnonzero(row[:n] == row[GRAM - 1 :])
    group = row[pos]
    for _ in range(ROUNDS):
        if not len(pos):
            return []
        bucket = (((key[pos] ^ (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
        live = np.bincount(bucket, minlength=COUNTERS)[bucket] > 1
        left, of = pos[live], group[live]
        new = np.r_[True, (left[1:] != left[:-1] + 1) | (of[1:] != of[:-1])]
        of = np.cumsum(new) - 1 if len(left) else of
        enough = (np.bincount(of) >= LEAST - GRAM + 1)[of] if len(left) else live[:0]
        left, of = left[enough], of[enough]
        if len(left) == len(pos):
            break
        pos, group = left, of
    new = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1] + 1) | (group[1:] != group[:-1])]) if len(pos) else []
    return [(int(pos[x]), int(pos[y - 1]) + GRAM) for x, y in zip(new, [*new[1:], len(pos)], strict=True)]


#: The words of a text in order, as places in it: (row number of the batch, number of words) -> places, or None for all as they are.
Order = Callable[[int, int], "np.ndarray | None"]


def _digests(each: np.ndarray, flat: pa.Array, order: Order) -> pa.RecordBatch:
    starts = np.r_[0, np.cumsum(each)]
    take = np.arange(starts[-1])
    for k, n in enumerate(each):
        if n and (own := order(k, int(n))) is not None:
            take[starts[k] : starts[k + 1]] = starts[k] + own
    ids, _ = numbered(flat)
    ids = ids[take]
    found: dict[int, list[tuple[int, int, int]]] = {}
    row = np.repeat(np.arange(len(each)), each)
    for x, y in may_hold_runs(ids, row):
        k = int(row[x])
        found.setdefault(k, []).extend((i + x - int(starts[k]), j + x - int(starts[k]), q) for i, j, q in runs(ids[x:y].tolist()))
    kept = np.ones(len(take), bool)
    cols: list[list] = [[] for _ in FIELDS]
    for k in range(len(each)):
        # stretches overlap by less than a run's words, so none is found twice
        own = sorted((i, j - i, q) for i, j, q in found.get(k, []))
        for i, n, q in own:
            kept[starts[k] + i + q : starts[k] + i + n] = False
        i, n, q = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{i},{n},{q}\n" for i, n, q in sorted(own, key=lambda r: (r[0], r[2])))
        for col, v in zip(cols, (len(own), i, n, q, n and 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest()), strict=False):
            col.append(v)
    left = np.r_[0, np.cumsum(kept)][starts]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.take(pa.array(take[kept]))), " ")
    cols[-1] = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.endswith("sha256") else pa.int64()) for c, f in zip(cols, FIELDS, strict=True)], list(FIELDS))


def _judged(order_of: Callable[[pa.RecordBatch], Order]):
    def run(batches):
        for b in batches:
            for s in slices(b):
                flat, each = words(s.column("text"))
                out = _digests(each, flat, order_of(s))
                names = [n for n in s.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([s.column(n) for n in names] + out.columns, names + list(FIELDS))

    return run


def _as_they_are(_: pa.RecordBatch) -> Order:
    return lambda k, n: None


def _with_repeats(batch: pa.RecordBatch) -> Order:
    """Every tenth document by its id ends in a repeated stretch of itself, the length and place of which follow from the id."""
    ids = batch.column("doc_id").to_pylist()

    def order(k: int, n: int) -> np.ndarray | None:
        if ids[k] is None:
            return None
        g, odd = divmod(zlib.crc32(str(ids[k]).encode()), 10)
        if odd:
            return None
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i = np.arange(n)
        return np.where(i < a, i, a + (i - a) % p)

    return order


def runs_of(docs: DataFrame, order_of: Callable[[pa.RecordBatch], Order] = _as_they_are) -> DataFrame:
    """docs (with `text`) without their text, and for each row its runs: number, the longest one, and digests of all runs and of the text without repeats.

    order_of: gets a batch and returns the places of a row's words to read in its stead, for texts that are edited on their way.
    """
    kept = [c for c in docs.columns if c not in FIELDS]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), SHAPE])
    return docs.mapInArrow(_judged(order_of), shape)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which every tenth by its id is given a repeated end first."""
    return runs_of(table(spark, sf_dir, "documents").select("doc_id", "text"), _with_repeats)
