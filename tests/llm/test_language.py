"""Language identification against a plain Bayesian computation, on pages and documents, and its accuracy on texts it did not see."""

import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stratalode.llm import language
from stratalode.llm.common import table

from .conftest import D, order

WORDS = re.compile(r"[^\W\d_]+")


def grams(text):
    return [zlib.crc32(f" {w} "[i : i + 3].encode()) % language.BUCKETS for w in WORDS.findall((text or "").lower()) for i in range(len(w))]


def plain(labelled, rows):
    """(lang, confidence, n) of rows (text, declared, host, suffix), from labelled (text, lang)."""
    langs = sorted({x for _, x in labelled})
    counts = np.full((language.BUCKETS, len(langs)), 0.5)
    for t, x in set(labelled):
        np.add.at(counts[:, langs.index(x)], grams(t), 1)
    log = np.log(counts / counts.sum(0))
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    logits, own, ns = [], [], []
    for t, *_ in rows:
        g = grams(t)
        z = log[g].sum(0) * min(1, 40 / max(len(g), 1)) if g else np.zeros(len(langs))
        logits.append(z - z.max())
        own.append(soft(z) if g else np.zeros(len(langs)))
        ns.append(len(g))
    low = lambda x: (x or "").lower()
    by = defaultdict(lambda: np.zeros(len(langs)))
    for (_, declared, host, suffix), o in zip(rows, own, strict=True):
        for k in (("host", low(suffix), low(host)), ("suffix", low(suffix)), ("all",), ("said", low(declared))):
            by[k] = by[k] + o
    mix = lambda c, p: (c + 20 * p) / (c.sum() + 20)
    root = (by[("all",)] + 1) / (by[("all",)].sum() + len(langs))
    said = sum((by[("said", x)] for x in langs), np.zeros(len(langs)))
    out = []
    for (_, declared, host, suffix), z, o, n in zip(rows, logits, own, ns, strict=True):
        p = mix(np.maximum(by[("host", low(suffix), low(host))] - o, 0), mix(by[("suffix", low(suffix))], root))
        z = z + np.log(p)
        if low(declared) in langs and ("said", low(declared)) in by:
            z = z + np.log((by[("said", low(declared))] + 1) / (said + len(langs)))
        post = soft(z)
        out.append((langs[int(post.argmax())] if n and post.max() >= 0.5 else None, float(post.max()), n))
    return out


def plain_page(url, html):
    body = None if html is None else re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ", html)
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    host = m[1].lower() if m else ""
    said = re.search(r"(?i)<html\b[^>]*\blang=[\"']?([a-zA-Z]{2})", html or "")
    return body, said[1].lower() if said else "", host, host.rpartition(".")[2]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(order(got), order(want), strict=True):
        assert a[0] == b[0] and a[1] == b[1] and a[3] == b[3] and math.isclose(a[2], b[2], rel_tol=1e-6), (a, b)


def test_pages(spark):
    """Null urls and pages, pages without letters, repeated rows and rows without id, and a column that clashes."""
    odd = [
        (-1, None, None), (-2, None, "<p>12 34</p>"), (-3, "no address", "<html lang=DE-at><p>der die das und nicht mit</p>"), (None, "http://a.b.de/x", "<b>ein Haus und der Baum</b>"),
        (None, "http://a.b.de/x", "<b>ein Haus und der Baum</b>"), (-3, "HTTPS://u:p@Host.FR:80/", "<html lang='fr'><style>und und</style>le la les des <!-- der die --> pas</html>"), (-4, "", ""),
    ]
    pages = table(spark, D, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    docs = table(spark, D, "documents")
    labelled = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None]
    rows = pages.collect()
    want = plain(labelled, [plain_page(r.url, r.html) for r in rows])
    got = language.identify(language.from_pages(pages.withColumn("host", F.lit("x"))), language.fit(docs, 10**6), "page_id")
    same([tuple(r) for r in got.select("page_id", "lang", "confidence", "n_trigrams").collect()], [(r.page_id, *w) for r, w in zip(rows, want, strict=True)])
    assert language.identify(language.from_pages(pages.limit(0)), language.fit(docs), "page_id").count() == 0


def test_documents(docs, empty):
    rows = docs.collect()
    labelled = [(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None]
    want = plain(labelled, [(r.text, r.lang, r.source, None) for r in rows])
    as_rows = docs.selectExpr("doc_id", "text", "lang declared", "source host", "cast(null as string) suffix")
    got = language.identify(as_rows, language.fit(docs, 10**6), "doc_id")
    same([tuple(r) for r in got.select("doc_id", "lang", "confidence", "n_trigrams").collect()], [(r.doc_id, *w) for r, w in zip(rows, want, strict=True)])
    kept = language.stage(docs.sparkSession, docs, D)
    assert kept.columns == docs.columns and order(map(tuple, kept.collect())) == order(tuple(r) for r, w in zip(rows, want, strict=True) if w[0])
    assert language.stage(docs.sparkSession, empty, D).count() == 0


def test_unseen_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null and lang is not null")
    half = F.pmod(F.xxhash64("text"), F.lit(2))  # copies stay together
    model = language.fit(docs.where(half == 0))
    rows = docs.where(half == 1).selectExpr("doc_id", "text", "cast(null as string) declared", "source host", "cast(null as string) suffix")
    got = language.identify(rows, model, "doc_id").join(docs.selectExpr("doc_id", "lang as known"), "doc_id").where("n_trigrams > 20")
    assert got.where("lang = known").count() >= 0.97 * got.count() > 300


def test_copies_do_not_fill_the_sample(spark):
    rows = [("aa bb", "xx")] * 500 + [(f"cc dd {chr(97 + i)}", "yy") for i in range(20)] + [("ee ff", "zz")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), 30)
    assert model.langs == ["xx", "yy", "zz"]
    some = language.fit(spark.createDataFrame(rows, "text string, lang string"), 3)
    assert some.langs == model.langs and not np.allclose(some.log, model.log)
    assert language.fit(spark.createDataFrame([], "text string, lang string")).langs == []


def test_pages_lose_their_markup_in_linear_time(spark):
    rng = random.Random(4)
    parts = ["<!--", "-->", "<script", "<SCRIPT>", "</script>", "</Script>", "<style a>", "</style>", "<", ">", "&amp;", "&x", "a", "b ", "<p>", "</p>", "\n", "<scripty>", "--", "é"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(18))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in pages] + [(None,)], "html string")
    got = [r.html for r in language.visible(df, "html").collect()]
    want = [r.t for r in df.select(F.regexp_replace("html", language.MARKUP, " ").alias("t")).collect()]
    letters = lambda t: None if t is None else re.sub(r"[^a-zé]+", " ", t.lower())
    assert [letters(t) for t in got] == [letters(t) for t in want]
    began = time.time()
    for text in ("<!--", "<script>", "<style>", "<", "<script", "</script><script>", "<!-->", "&a", "<script>a</script", "<!--<script>-->"):
        long = spark.createDataFrame([(text * (1_000_000 // len(text)),)], "html string")
        assert language.visible(long, "html").count() == 1 and language.visible(long, "html").first() is not None
    assert time.time() - began < 60
