"""Source divergence against its SQL on whole small tables, and against plain integers on odd and random rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import divergence as dv
from stratalode.llm.catalog import ORACLES

from .conftest import D, lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    counts, held = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        held.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, sources in counts.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // total for t in kept}

        shares, q = {s: p(c) for s, c in sources.items()}, p(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(shares[s][t], q[t])) for t in kept if sources[s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_odd_rows(spark, docs):
    odd = docs.withColumns({"lang": F.when(F.col("doc_id") % 5 != 0, F.col("lang")), "source": F.when(F.col("doc_id") % 7 != 0, F.col("source")), "term": F.lit("x"), "docs": F.lit(1)})
    got = dv.divergence(odd)
    assert sorted(map(tuple, got.collect())) == brute([(r.lang, r.source, r.text) for r in odd.collect()])
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert dv.divergence(odd.limit(0)).collect() == []


@pytest.mark.parametrize(("dense", "side"), [(2_000_000, 2048), (10, 2048), (64, 2)])
def test_chunks_of_any_size(spark, dense, side, monkeypatch):
    for k, v in (("DENSE", dense), ("SIDE", side), ("HELD", 50), ("RANGE", 40)):
        monkeypatch.setattr(dv, k, v)
    rng = random.Random(3)
    words = [*"abcdefghij", "É", "é", "￿", "\U0001f600", "zz", "a1b", "x" * 5000]
    rows = [(rng.choice(["en", "de", None]), f"s{min(rng.randrange(30), 8)}", " ".join(rng.choices(words, k=rng.randrange(20)))) for _ in range(600)]
    rows += [("lone", "s", "one"), ("rare", "s", "few words"), ("rare", "t", None), ("rare", "u", "few")]
    got = dv.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least=4, top=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 3)


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(4)
    for _ in range(300):
        c = [rng.randrange(rng.choice((3, 10**6, 10**13))) for _ in range(5)]
        total = sum(c) + 2 * len(c)
        assert dv.shares(np.array(c), total).tolist() == [1 + 1_000_000_000 * (x + 2) // total for x in c]


def test_long_text(spark):
    text = "word tail " * 600_000
    got = dv.divergence(spark.createDataFrame([("en", "a", text), ("en", "b", "tail")], "lang string, source string, text string"), least=1)
    assert sorted(map(tuple, got.collect())) == brute([("en", "a", text), ("en", "b", "tail")], 1)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    got, want = dv.op11_source_divergence(spark, D).select(*cols).collect(), con.sql(f"select {', '.join(cols)} from ({ORACLES['op11_source_divergence']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.part for r in got}) == 2
