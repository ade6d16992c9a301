"""URL filters against a plain matcher that tries every rule on every URL."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalode.llm import url_filters as u
from stratalode.llm.catalog import ORACLES

D = "/root/testdata/sf0.001"
HOSTS = [*u.HOST_RULES, ("a.b.net/x", "allow"), ("b.net/x/yy", "block"), ("b.net/x/yy", "allow"), ("local", "block"), ("q*.org/a^b/", "block"), ("example.com/DE/", "allow")]
PATTERNS = [*u.PATTERN_RULES, ("", "allow") , ("||cdn.*/img^", "block"), ("|http://exact/|", "block"), ("ünï*^", "block"), ("a.c|", "block")]
URLS = [
    None, "", "no scheme", "net/", "http://net", "http://net/", "http://NET/", "https://x.net?q", "https://xnet/", "http://example.net/en/1", "http://www.Example.NET/en/", "http://example.net/EN/",
    "http://example.net/en", "http://a.b.net/x/yy/z", "http://b.net/x/yy", "http://b.net/x", "http://local", "http://my.local#f", "http://local:80/", "http://q*.org/a^b/c", "http://qq.org/a^b/c",
    "ftp://h/p", "http://h/setup.EXE", "http://h/setup.exe?x", "http://my-casino/", "http://casino-x.org/", "http://h/casino-x", "http://cdn.a.b/img/1", "http://cdn.a.b/img", "http://cdn.a.b/images",
    "http://exact/", "http://exact/1", "http://h/ünïx/", "http://h/ÜNÏ", "http://abc", "http://h/a.c", "a://b://c.net/fr/", "http://free-bets.org/fr/x", "http://h/?gclid=1", "http://h/\n.net/", "http://h\n.org/fr/",
    "http://x/" + "viagr" * 500, "http://x/" + "viagra/" * 500, "http://a.casino-.b/-casino", "http://a.exe.b.exe", "http://example.com/de/1", "http://example.com/DE/1", "://net/", "http:///en/", "http://.net/", "http://net./", "http://example.org/1/about",
]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def judged(url, hosts, patterns):
    t = url or ""
    at = t.find("://")
    rest = t[at + 3 :] if at >= 0 else ""
    host = low(re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = []
    for rule, verdict in set(hosts):
        name, slash, start = rule.partition("/")
        if at >= 0 and (host == low(name) or host.endswith("." + low(name))) and path.startswith(slash + start):
            fits.append((len(rule), len(name), verdict == "block", rule, verdict))
    if fits:
        return host, path, max(fits)[3], None, max(fits)[4]
    fits = []
    for rule, verdict in set(patterns):
        r, start, end = low(rule), "", ""
        if r.startswith("||"):
            r, start = r[2:], r"\A[^/?#]*?://([^/?#]*\.)?"
        elif r.startswith("|"):
            r, start = r[1:], r"\A"
        if r.endswith("|"):
            r, end = r[:-1], r"\Z"
        sign = {"*": ".*", "^": r"([\x00-\x24\x26-\x2c\x2f\x3a-\x5e\x60\x7b-\x7f]|\Z)"}
        if url is not None and re.search(start + "".join(sign.get(c, re.escape(c)) for c in r) + end, low(url), re.S):
            fits.append((verdict == "block", -len(rule), rule, verdict))
    return (host, path, None, *(min(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("patterns", [PATTERNS, [p for p in PATTERNS if p[0]]])
def test_every_rule_on_every_url(spark, patterns, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(u, "BROADCAST_BYTES", 0)
    rows = [(i % 40 if i % 7 else None, t, "mine", "k") for i, t in enumerate(URLS + URLS[:20])]
    pages = spark.createDataFrame(rows, "page_id long, url string, token string, verdict string")
    got = u.judge(pages, u.rules(spark, HOSTS + HOSTS[:2], patterns))
    assert got.columns == ["page_id", "url", "token", "host", "path", "rule", "pattern", "verdict"]
    want = [(r[0], r[1], "mine", *judged(r[1], HOSTS, patterns)) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    some, none = u.rules(spark, HOSTS, PATTERNS), u.rules(spark, HOSTS, PATTERNS).limit(0)
    assert u.judge(pages.limit(0), some).collect() == []
    assert [tuple(r) for r in u.judge(pages, none).collect()] == [(1, "http://net/", "net", "/", None, None, "allow")]
    odd = spark.createDataFrame([(None, "net/", "block"), ("host", None, "block"), ("host", "net/", "maybe"), ("other", "net/", "block")], "kind string, rule string, verdict string")
    assert u.judge(pages, odd).first().verdict == "allow"


def test_long_urls_take_linear_time(spark):
    texts = ["http://x/" + "viagr" * 100_000, "http://" + "a." * 200_000 + "q", "http://x/" + "aaff/affiliate/" * 50_000, "a" * 1_000_000, "http://x" + "://" * 200_000]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, url string")
    began = time.time()
    got = u.judge(pages, u.rules(spark, u.HOST_RULES, u.PATTERN_RULES)).select("page_id", "verdict").collect()
    assert {tuple(r) for r in got} == {(i, "allow") for i in range(len(texts))} and time.time() - began < 60


def test_rules_lie_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://www.shop.net/en/{i}",) for i in range(9)] + [("http://rare.net/",)], "url string")
    index = {r.rule: r.token for r in u.indexed(u.rules(spark, [("shop.net/en/", "block"), ("rare.net/e", "block")], [("*op*", "block"), ("||www.*", "block")]), urls, True).collect()}
    assert index == {"shop.net/en/": "en", "rare.net/e": "rare", "*op*": "", "||www.*": "www"}


def test_plan_stays_in_the_jvm_and_joins_rules_by_token(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url")
    plan = u.judge(pages, u.rules(spark, u.HOST_RULES, u.PATTERN_RULES))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian", plan)
    assert all(" Cross" not in line and re.search(r"token#\d+ = token#|__at#\d+ = __url#", line) for line in plan.split("\n") if "Join" in line)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{D}/pages.parquet'")
    got, want = u.op13_url_filters(spark, D).toPandas(), con.sql(ORACLES["op13_url_filters"]).df()
    cols = sorted(want.columns)
    key = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert sorted(got.columns) == cols and key(got) == key(want)
    assert {r.verdict for r in u.op13_url_filters(spark, D).select("verdict").distinct().collect()} == {"allow", "block"}
    assert u.op13_url_filters(spark, D).where(F.col("pattern").isNotNull()).count() > 0
