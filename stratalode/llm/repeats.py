"""Substring dedup with suffix automata of reference shards.

A stretch of at least `window` words that also stands in a document with a smaller doc_id is
removed. No document is held against the whole corpus; it meets only the references it may match:

1. Anchors. Winnowing picks from every `window` words at least one shorter run, by its hash alone,
   so documents that share a window share an anchor. Anchors of two or more documents are repeated.
2. Windows around repeated anchors are grouped by hash. Each repeated one gets as its
   reference a smaller document that has it. Tasks first settle what repeats among their own documents
   and pass on one document per anchor or window, so a very common passage is no hot spot.
3. Reference stretches are dealt into shards. Each shard's suffix automaton over words, with the smallest
   doc_id of every state, is built once and written to the shared folder. It is then sent to the tasks among
   which the shard's documents are divided. Documents stream through it; the matching statistics, word by
   word, decide what goes. All automata together grow with the corpus, so none is sent where no document
   of the task can match; the automaton of one shard stays small, since there are more shards for more text.

Hashes only choose who meets whom: what is removed was matched word by word.
"""

from __future__ import annotations

import hashlib
import marshal

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_part, even_key, even_keys, parts_for, stored, table

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Anchors or windows that a task gathers before it passes them on.
GATHERED = 2_000_000
REMEMBERED = 300_000
#: Words, and stretches, of documents that one task streams through a shard's automaton.
STREAMED, STRETCHES = 1_000_000, 256
#: Bytes of input that a part stands for at most.
PART_BYTES = 16 << 20
DONE, TEXT, WINDOW, HIT, REF = range(5)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", INVERSE)):
            a = np.full(max(n, 1 << 16), b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Known(dict):
    """Hashes of words, each computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = self[word] = xxh64_intdigest(word)
        return h


class Hasher:
    """Hashes of words, and of runs of words."""

    def __init__(self):
        self.known = Known()

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def runs(h: np.ndarray, k: int) -> np.ndarray:
        """One hash for each run of k words: a polynomial modulo 2**64, mixed."""
        if len(h) < k:
            return np.zeros(0, np.uint64)
        up, down = powers(len(h))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
        return mixed((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def anchor_hashes(runs: np.ndarray, span: int) -> np.ndarray:
    """The least hash of every `span` neighbours."""
    if len(runs) < span:
        return np.zeros(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(runs, span).min(1))


def pack(key: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys as differences, the rest as it is, all byte by byte."""
    cols = [np.diff(key.astype(np.uint64), prepend=np.uint64(0)), *(m.astype(np.int64).view(np.uint64) for m in more)]
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in cols), 1)


def unpack(data: list[bytes], columns: int) -> list[np.ndarray]:
    got: list[list[np.ndarray]] = [[] for _ in range(columns)]
    for d in data:
        a = np.frombuffer(zstandard.decompress(d), np.uint8).reshape(columns, 8, -1)
        for i in range(columns):
            c = np.ascontiguousarray(a[i].T).view(np.uint64).ravel()
            got[i].append(np.cumsum(c, dtype=np.uint64) if i == 0 else c.view(np.int64))
    return [np.concatenate(g) if g else np.zeros(0, np.int64 if i else np.uint64) for i, g in enumerate(got)]


def place(ids: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each doc_id; the same as placed()."""
    return (ids ^ (ids >> 17) ^ (ids >> 33)) % n


def placed(n: int, or_else: str = "doc_id") -> Column:
    """The even key of place(); rows without doc_id, which nothing is sent to, lie by the hash of another column."""
    d = F.coalesce(F.col("doc_id"), F.xxhash64(or_else))
    return even_key(F.pmod(d.bitwiseXOR(F.shiftright(d, 17)).bitwiseXOR(F.shiftright(d, 33)), F.lit(n)).cast("int"), n)


def settle(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, id), and the least id that each key has."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
        key, ids = key[new], ids[new]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key, ids, np.repeat(ids[starts], np.diff(np.append(starts, len(key))))
    return key, ids, ids


def several(key: np.ndarray, ids: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows have a key that more than one id has."""
    if not len(key):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(starts, len(key)))
    return np.repeat(n > 1, n)


def dealt(kind: int, to: np.ndarray, n: int, *cols: np.ndarray):
    """Rows (kind, part, data) for each of n parts, by its even key; cols sorted by the first."""
    if not len(to):
        return []
    keys = even_keys(n)
    order = np.argsort(to, kind="stable")
    to, cols = to[order], [c[order] for c in cols]
    parts, at = np.unique(to, return_index=True)
    ends = np.append(at[1:], len(to))
    return [(kind, int(keys[p]), pack(*(c[i:j] for c in cols))) for p, i, j in zip(parts, at, ends, strict=True)]


def top(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the key, which keeps differences within a part small."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


BLOB = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def blobs(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOB, strict=True)], schema=BLOB)


def _anchors(parts: int, buckets: int, window: int, run: int):
    def flush(got):
        key = np.concatenate([g for g, _ in got])
        key, ids, least = settle(key, np.repeat(np.array([d for _, d in got], np.int64), [len(g) for g, _ in got]))
        known = several(key, ids, least)
        own = ids == least
        return blobs(dealt(WINDOW, top(key[own], parts), parts, key[own], ids[own]) + dealt(HIT, place(ids[known], buckets), buckets, key[known], ids[known]))

    def go(batches):
        of, got, n = Hasher(), [], 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if d is None or not t:
                    continue
                a = anchor_hashes(of.runs(of.words(t.split()), run), window - run + 1)
                if len(a):
                    got.append((a, d))
                    n += len(a)
                if n >= GATHERED:
                    yield flush(got)
                    got, n = [], 0
        if got:
            yield flush(got)

    return go


def _repeated(buckets: int):
    def go(t: pa.Table) -> pa.Table:
        key, ids, least = settle(*unpack(t.column("data").to_pylist(), 2))
        known = several(key, ids, least)
        return pa.Table.from_batches([blobs(dealt(HIT, place(ids[known], buckets), buckets, key[known], ids[known]))])

    return go


def _owned(data: list[bytes], columns: int) -> dict[int, list[np.ndarray]]:
    """Rows by their second column, the doc_id."""
    cols = unpack(data, columns)
    if not len(cols[1]):
        return {}
    order = np.argsort(cols[1], kind="stable")
    cols = [c[order] for c in cols]
    ids, at = np.unique(cols[1], return_index=True)
    ends = np.append(at[1:], len(cols[1]))
    return {int(d): [c[i:j] for c in cols] for d, i, j in zip(ids, at, ends, strict=True)}


FOUND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("data", pa.binary()), ("digest", pa.string())])


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _windows(parts: int, buckets: int, window: int, run: int):
    def go(docs: pa.Table, known: pa.Table) -> pa.Table:
        own, of, rows, keys, ids = _owned(known.column("data").to_pylist(), 2), Hasher(), [], [], []
        for d, t, p in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist(), docs.column("part").to_pylist(), strict=True):
            words = (t or b"").split()
            if d is None or d not in own:
                rows.append((DONE, p, d, len(words), None, digest(words)))
                continue
            rows.append((TEXT, p, d, len(words), t, None))
            h = of.words(words)
            at = np.flatnonzero(np.isin(of.runs(h, run), own[d][0]))
            whole = of.runs(h, window)
            near = np.zeros(len(whole) + window + 1, np.int64)  # starts of windows around an anchor
            np.add.at(near, np.maximum(at - (window - run), 0), 1)
            np.add.at(near, at + 1, -1)
            keys.append(np.unique(whole[np.cumsum(near)[: len(whole)] > 0]))
            ids.append(np.full(len(keys[-1]), d, np.int64))
        if keys:
            key, doc, least = settle(np.concatenate(keys), np.concatenate(ids))
            hit, ref = doc > least, several(key, doc, least) & (doc == least)
            packed = dealt(WINDOW, top(key[~hit], parts), parts, key[~hit], doc[~hit])
            packed += dealt(HIT, place(doc[hit], buckets), buckets, key[hit], doc[hit], least[hit])
            packed += dealt(REF, place(doc[ref], buckets), buckets, key[ref], doc[ref])
            rows += [(k, p, None, None, data, None) for k, p, data in packed]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)

    return go


def _references(buckets: int):
    def go(t: pa.Table) -> pa.Table:
        key, doc, least = settle(*unpack(t.column("data").to_pylist(), 2))
        hit, ref = doc > least, several(key, doc, least) & (doc == least)
        got = dealt(HIT, place(doc[hit], buckets), buckets, key[hit], doc[hit], least[hit]) + dealt(REF, place(doc[ref], buckets), buckets, key[ref], doc[ref])
        return pa.Table.from_batches([blobs(got)])

    return go


#: `row` is a hash of the whole text: rows may share a doc_id.
SPAN = pa.schema([("shard", pa.int32()), ("is_ref", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def row_of(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) - (1 << 63)


def runs_of(starts: np.ndarray, label: np.ndarray):
    """(first, last, label) of stretches of neighbouring starts with one label."""
    if len(starts):
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(label) != 0)) + 1
        for i, j in zip(np.append(0, cut), np.append(cut, len(starts)), strict=True):
            yield int(starts[i]), int(starts[j - 1]), int(label[i])


def _spans(shards: int, window: int):
    def go(docs: pa.Table, known: pa.Table) -> pa.Table:
        of, rows = Hasher(), []
        kinds, data = known.column("kind").to_pylist(), known.column("data").to_pylist()
        hits = _owned([x for k, x in zip(kinds, data, strict=True) if k == HIT], 3)
        refs = _owned([x for k, x in zip(kinds, data, strict=True) if k == REF], 2)
        seen = set()
        for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("data").to_pylist(), strict=True):
            if d not in hits and d not in refs:
                continue
            words, row = t.split(), row_of(t)
            whole = of.runs(of.words(words), window)
            if d in hits:
                key, _, ref = hits[d]
                order = np.argsort(key)
                at = np.flatnonzero(np.isin(whole, key))
                to = place(ref[order][np.searchsorted(key[order], whole[at])], shards)
                rows += [(s, False, d, row, i, j + window - i, b" ".join(words[i : j + window])) for i, j, s in runs_of(at, to)]
            if d in refs and (d, t) not in seen:
                seen.add((d, t))
                at = np.flatnonzero(np.isin(whole, refs[d][0]))
                s = int(place(np.array([d]), shards)[0])
                rows += [(s, True, d, row, i, j + window - i, b" ".join(words[i : j + window])) for i, j, _ in runs_of(at, at * 0)]
        cols = list(zip(*rows, strict=True)) or [[]] * len(SPAN)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SPAN, strict=True)], schema=SPAN)

    return go


class Automaton:
    """Suffix automaton over words of several texts; each state knows the smallest doc_id where it occurs."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.doc = [-1], [0], [1 << 62]

    def _state(self, next_: dict, link: int, size: int, doc: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.size.append(size)
        self.doc.append(doc)
        return len(self.size) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        k = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.doc[q])
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for c in words:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
                self.doc[last] = min(self.doc[last], doc)
                continue
            last = self._state({}, 0, self.size[p] + 1, doc)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[last] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)

    def finish(self) -> None:
        for i in np.argsort(self.size)[:0:-1].tolist():
            up = self.link[i]
            self.doc[up] = min(self.doc[up], self.doc[i])

    def packed(self) -> bytes:
        return zstandard.compress(marshal.dumps((self.next, self.link, self.size, self.doc)), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        out = cls()
        out.next, out.link, out.size, out.doc = marshal.loads(zstandard.decompress(data))  # noqa: S302, written by packed()
        return out

    def matched(self, words: list[bytes], doc: int, window: int):
        """Ends of the stretches of `window` words that also stand in a text of a smaller doc_id."""
        nxt, link, size, least = self.next, self.link, self.size, self.doc
        v = n = 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = size[v]
            v = nxt[v].get(c, 0)
            n = n + 1 if v else 0
            if n >= window:
                n = window  # only the last `window` words matter, so the state is the shortest that holds them
                while size[link[v]] >= window:
                    v = link[v]
                if least[v] < doc:
                    yield i


def _build(t: pa.Table) -> pa.Table:
    """The automaton of a shard."""
    auto = Automaton()
    for d, words in zip(t.column("doc_id").to_pylist(), t.column("words").to_pylist(), strict=True):
        auto.add(words.split(b" "), d)
    auto.finish()
    return pa.table([t.column("shard").slice(0, 1).cast(pa.int32()), pa.array([auto.packed()], pa.binary())], ["shard", "automaton"])


GONE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _match(window: int):
    """Streams a task's stretches through the automaton of their shard."""

    def go(stretches: pa.Table, automata: pa.Table) -> pa.Table:
        out = []
        if stretches.num_rows and automata.num_rows:
            auto = Automaton.unpacked(automata.column("automaton")[0].as_py())
            for r in stretches.select(["doc_id", "row", "at", "words"]).to_pylist():
                d, row = r["doc_id"], r["row"]
                for i in auto.matched(r["words"].split(b" "), d, window):
                    a, b = r["at"] + i - window + 1, r["at"] + i
                    if out and out[-1][:2] == (d, row) and out[-1][2] <= a <= out[-1][3] + 1:
                        out[-1] = (*out[-1][:3], b)
                    else:
                        out.append((d, row, a, b))
        cols = list(zip(*out, strict=True)) or [[]] * len(GONE)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, GONE, strict=True)], schema=GONE)

    return go


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _cut(docs: pa.Table, gone: pa.Table) -> pa.Table:
    spans: dict[tuple[int, int], list] = {}
    for r in gone.select(GONE.names).to_pylist():
        spans.setdefault((r["doc_id"], r["row"]), []).append((r["first"], r["last"]))
    out = []
    for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("data").to_pylist(), strict=True):
        words = t.split()
        keep = np.ones(len(words), bool)
        for a, b in spans.get((d, row_of(t)), ()):
            keep[a : b + 1] = False
        left = [w for w, k in zip(words, keep, strict=True) if k]
        out.append((d, len(words), len(words) - len(left), digest(left), b" ".join(left).decode()))
    cols = list(zip(*out, strict=True)) or [[]] * len(RESULT)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RESULT, strict=True)], schema=RESULT)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, where some were removed).

    Words are split at ASCII white space. Null and wordless texts have none. Rows without doc_id
    neither lose words nor serve as references; rows with one doc_id are each judged against
    smaller ones, never against one another. Repeated rows give repeated results. Of several documents that
    share a window the one with the smallest doc_id keeps it, so ties can't arise. Long texts are whole. No
    rows: no rows. Other columns are ignored.
    """
    n = parts_for(docs, PART_BYTES, 400)
    run, shards = window // 2, 4 * n + 1
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    blob, found = "kind int, part int, data binary", "kind int, part int, doc_id long, n_words long, data binary, digest string"
    anchors = stored(docs.mapInArrow(_anchors(n, n, window, run), blob), "anchors")
    known = anchors.where(F.col("kind") == HIT).unionByName(by_part(anchors.where(F.col("kind") == WINDOW), n).applyInArrow(_repeated(n), blob))
    near = by_part(docs.withColumn("part", placed(n, "text")), n).cogroup(by_part(known, n))
    near = stored(near.applyInArrow(_windows(n, n, window, run), found), "windows")
    texts = near.where(F.col("kind") == TEXT).select("part", "doc_id", "data")
    sets = near.select("kind", "part", "data")
    refs = sets.where(F.col("kind").isin(HIT, REF)).unionByName(by_part(sets.where(F.col("kind") == WINDOW), n).applyInArrow(_references(n), blob))
    spans = by_part(texts, n).cogroup(by_part(refs, n))
    spans = stored(spans.applyInArrow(_spans(shards, window), "shard int, is_ref boolean, doc_id long, row long, at long, n long, words binary"), "spans")
    tasks = F.ceil(F.greatest(F.sum("n") / STREAMED, F.count(F.lit(1)) / STRETCHES)).cast("int")
    sizes = stored(spans.where("not is_ref").groupBy("shard").agg(tasks.alias("tasks")), "shards")
    sizes = F.broadcast(sizes)  # as many rows as shards, a parameter
    automata = stored(spans.where("is_ref").groupBy("shard").applyInArrow(_build, "shard int, automaton binary"), "automata", compression="none")
    automata = automata.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "automaton")
    stretches = spans.where("not is_ref").join(sizes, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id", "row", "at"), F.col("tasks")).cast("int")).drop("tasks", "is_ref", "n")
    gone = stretches.groupBy("shard", "task").cogroup(automata.groupBy("shard", "task"))
    gone = gone.applyInArrow(_match(window), "doc_id long, row long, first long, last long").withColumn("part", placed(n))
    cut = by_part(texts, n).cogroup(by_part(gone, n)).applyInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    done = near.where(F.col("kind") == DONE)
    done = done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return done.unionByName(cut)


def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
