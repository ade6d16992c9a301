"""Periodic runs against every period at every place, and the query against the same on whole small tables and odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import runs as r
from stratalode.llm.common import table

from .conftest import D, order

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s):
    """Stretches in which words q apart agree, for every q; equal stretches keep the smallest."""
    out = {}
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j, q) for (i, j), q in out.items())


def test_runs_of_random_words():
    rng = random.Random(5)
    for k in range(6000):
        n, letters = rng.randrange(0, 70), rng.choice((1, 2, 2, 3, 5))
        s = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):  # repeated and nested stretches
            part = s[(a := rng.randrange(len(s) + 1)) : a + rng.randrange(1, 9)]
            s[(at := rng.randrange(len(s) + 1)) : at] = part * rng.randrange(2, 7)
        if rng.random() < 0.3:
            s = s + [9] * rng.randrange(3) + s
        assert r.runs(s) == brute(s), s
    for s in ([], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2, 1, 2, 1, 2, 1], [1, 1, 2] * 40 + [1, 1, 1, 1, 1, 1], ([1] * 6 + [2]) * 6):
        assert r.runs(s) == brute(s)


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(6)
    for _ in range(400):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        at = 0
        for b, n, source in r.factors(s):
            assert b == at and n >= 1
            earlier = lambda m: any(s[i : i + m] == s[b : b + m] for i in range(b))  # noqa: B023,E731
            assert (earlier(n) and s[source : source + n] == s[b : b + n] and source < b) if source >= 0 else not earlier(1)
            assert b + n == len(s) or not earlier(n + 1) or source < 0
            at += n
        assert at == len(s)


def test_filter_keeps_every_run():
    rng = random.Random(7)
    for _ in range(300):
        texts = [[rng.randrange(4) for _ in range(rng.randrange(60))] + [7] * rng.choice((0, 6)) for _ in range(rng.randrange(1, 6))]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.array([w for t in texts for w in t], np.int64)
        starts = np.r_[0, np.cumsum([len(t) for t in texts])]
        kept = r.may_hold_runs(flat, row)
        for k, t in enumerate(texts):
            for i, j, _q in brute(t):
                assert any(x <= starts[k] + i and starts[k] + j <= y for x, y in kept)
        assert all(len(set(row[x:y])) == 1 for x, y in kept)


def row_of(doc_id, text, edited=True):
    ws = WORDS.findall(text or "")
    n = len(ws)
    if edited and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    number = {}
    found = brute([number.setdefault(w, len(number)) for w in ws])
    gone = {x for i, j, q in found for x in range(i + q, j)}
    i, j, q = min(found, key=lambda x: (x[0] - x[1], x[0], x[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{i},{j - i},{q}\n" for i, j, q in sorted(found, key=lambda x: (x[0], x[2])))
    longest = (i, j - i, q, 1000 * (j - i) // q) if found else (None,) * 4
    return (doc_id, len(found), *longest, sha(lines), sha(" ".join(w for x, w in enumerate(ws) if x not in gone)))


def test_query_on_whole_tables(spark):
    got = [tuple(x) for x in r.op12_periodic_runs(spark, D).collect()]
    want = [row_of(x.doc_id, x.text) for x in table(spark, D, "documents").collect()]
    assert order(got) == order(want) and sum(x[1] > 0 for x in got) > 5


def test_odd_rows(docs, texts):
    odd = docs.where("doc_id is null or doc_id > 900000 or doc_id < 0")
    got = [tuple(x) for x in r.runs_of(odd.select("doc_id", "text"), r._with_repeats).collect()]
    assert order(got) == order([row_of(i, "tok" if t == "tok " * 30000 else t) if t != "tok " * 30000 else many(i) for i, t in texts if i is None or i > 900000 or i < 0])
    out = r.runs_of(docs.withColumns({"period": F.lit("mine")}))
    assert dict(out.dtypes)["period"] == "bigint" and set(out.columns) == (set(docs.columns) - {"text"}) | set(r.FIELDS)
    assert out.count() == len(texts) and r.runs_of(docs.limit(0)).collect() == []


def many(doc_id):
    """One word 30 000 times, edited or not, is one run."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, 1, 0, 30000, 1, 30_000_000, sha("0,30000,1\n"), sha("tok"))


@pytest.mark.parametrize("text", ["a b c d e f g " * 20_000, "w " * 140_000, " ".join(str(i % 3000) for i in range(140_000)), " ".join(random.Random(1).choices("abc", k=140_000))])
def test_long_texts_take_linear_time(text):
    import pyarrow as pa

    began = time.time()
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    out = list(r._judged(r._as_they_are)([batch]))
    assert out[0].num_rows == 1 and time.time() - began < 30
