"""URL filters: host and path rules and pattern rules, fetched by their rarest literal token.

Every rule is compiled to a regular expression and the tokens (words of [a-z0-9] and what lies outside ASCII) that any URL it fits
must hold. A count of these tokens over all URLs picks each rule's rarest one, under which the rule is indexed. A URL's own tokens
fetch its candidate rules by a join, and only these run their expressions. A rule without a whole token is a candidate for every URL.

Results at the edges. A null URL or one without `://` has an empty host and path, which no host rule fits; pattern rules see the text
of the latter, and no rule fits null. Very long URLs are read whole, in time proportional to their length for any one rule. Of host
rules that fit, the longest wins, then the one with the longer host, then blocking. Of pattern rules that fit, one that allows wins,
then the longest, then the first by UTF-8. Repeated rules count once; repeated pages are judged alike and all kept. No pages give no
rows, no rules allow everything. Columns of pages that are named as one of the results (host, path, rule, pattern, verdict) are
replaced. Rules of an unknown kind or verdict and null ones are left out; the empty pattern fits every URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: One sign of a token.
SIGN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NO_TOKEN = ""
#: Rules are broadcast while their texts and ROW_BYTES a rule take this much at most; beyond it they are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 200
RESULT = ("host", "path", "rule", "pattern", "verdict")

#: (host and path, verdict): a host stands for its subdomains too.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: (pattern, verdict): * any signs, ^ one sign that is no letter, digit or _.%- (or the end), || the start of a label of the host, | the start or end of the URL.
PATTERN_RULES = [
    ("-casino^", "block"), ("||casino-", "block"), ("||free-bets.", "block"), ("||cheap-pills.", "block"), ("||adult-*.", "block"), ("||spam-farm.", "block"),
    ("||ads-track*.", "block"), ("^doubleclick^", "block"), ("^affiliate^*^click^", "block"), ("/wp-login.php", "block"), (".exe|", "block"), (".apk|", "block"),
    ("|ftp://", "block"), ("^gclid=", "block"), ("^sessionid=", "block"), ("*viagra*", "block"), ("||example.org/*/about^", "allow"),
]


def rules(spark: SparkSession, hosts: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """Rules as rows: kind (host or pattern), rule, verdict. Any table with these columns will do as well."""
    rows = [("host", r, v) for r, v in hosts] + [("pattern", r, v) for r, v in patterns]
    return spark.createDataFrame(rows, "kind string, rule string, verdict string")


def _path_of(rule: str) -> Column:
    return F.expr(f"substring({rule}, length(substring_index({rule}, '/', 1)) + 1)")


def compiled(rules: DataFrame) -> DataFrame:
    """The rules, each once, with a regular expression and the whole tokens of every URL that it fits.

    Host rules run on host?path, since neither part can hold a question mark; patterns run on the URL in lower case.
    """
    literal = lambda c: F.regexp_replace(c, r"([\\.$|?+(){}\[\]*^])", r"\\$1")
    host, path = ascii_lower(F.substring_index("rule", "/", 1)), _path_of("rule")
    of_host = F.concat(F.lit(r"(?s)^(?:.*\.)?"), literal(host), F.lit(r"\?"), literal(path))

    # a part between stars is taken where it first fits and not moved again, so that no URL makes a pattern slow; only the last part of a pattern that is bound to the end lies there
    low = ascii_lower(F.col("rule"))
    body = F.regexp_replace(F.regexp_replace(low, r"^\|\|?", ""), r"\|$", "")
    parts, bound = F.split(F.regexp_replace(body, r"([\\.$|?+(){}\[\]])", r"\\$1"), r"\*"), low.endswith("|")

    def part(x: Column, i: Column) -> Column:
        last = bound & (i == F.size(parts) - 1)
        before = F.when(i > 0, F.when(last, ".*").otherwise(".*?")).when(low.startswith("||"), r"[^/?#]*?://(?:[^/?#]*?\.)??").when(low.startswith("|"), "").when(last, ".*").otherwise(".*?")
        signs = F.concat(before, F.replace(x, F.lit("^"), F.lit(r"(?:[^a-z0-9_.%\x{80}-\x{10FFFF}-]|\z)")))
        return F.when(last, F.concat(signs, F.lit(r"\z"))).otherwise(F.concat(F.lit("(?>"), signs, F.lit(")")))

    of_pattern = F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(parts, part), ""))

    # a run of signs that touches a star or an open end may be a part of a longer token of the URL
    open_start, open_end = F.when(low.startswith("|"), "").otherwise("*"), F.when(low.endswith("|"), "").otherwise("*")
    is_host = F.col("kind") == "host"
    text = F.when(is_host, F.concat(F.translate(F.concat(host, F.lit("?"), ascii_lower(path)), "*", " "), F.lit("*"))).otherwise(F.concat(open_start, body, open_end))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!\*|{SIGN})({SIGN}+)(?!{SIGN}|\*)"), F.lit(1)))
    kept = rules.where("kind in ('host', 'pattern') and rule is not null and verdict in ('allow', 'block')").select("kind", "rule", "verdict").distinct()
    return kept.withColumns({"regex": F.when(is_host, of_host).otherwise(of_pattern), "tokens": tokens})


def _url_tokens(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(ascii_lower(url), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""))


def _host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 2)


def indexed(rules: DataFrame, urls: DataFrame, small: bool) -> DataFrame:
    """The compiled rules with `token`: of each rule's tokens the one that fewest of the URLs hold, of equals the first by UTF-8."""
    each = compiled(rules).select("*", F.explode_outer("tokens").alias("token")).drop("tokens")
    wanted = each.select("token").where("token is not null").distinct()
    held = urls.select(F.explode(_url_tokens(F.col("url"))).alias("token"))
    seen = held.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))
    by_rule = each.join(seen, "token", "left").groupBy("kind", "rule", "verdict", "regex").agg(rarest.alias("best"))
    return by_rule.select("kind", "rule", "verdict", "regex", F.coalesce("best.token", F.lit(NO_TOKEN)).alias("token"))


def decided(urls: DataFrame, index: DataFrame, small: bool) -> DataFrame:
    """For every distinct URL that a rule fits: host_rule and by_pattern, each a struct with rule and verdict, or null."""
    host, path = _host(F.col("url")), _path(F.col("url"))
    tokens = F.explode(F.array_union(F.array(F.lit(NO_TOKEN)), _url_tokens(F.col("url"))))
    mine = urls.where("url is not null").distinct().select("url", ascii_lower(F.col("url")).alias("low"), F.concat(host, F.lit("?"), path).alias("parts"), tokens.alias("token"))
    fits = mine.join(F.broadcast(index) if small else index, "token").where("case when kind = 'host' then parts else low end rlike regex")
    is_host, blocks, size = F.col("kind") == "host", F.col("verdict") == "block", F.length("rule")
    longest = F.max(F.when(is_host, F.struct(size, F.length(F.substring_index("rule", "/", 1)), blocks, "rule", "verdict")))
    first = F.min(F.when(~is_host, F.struct(blocks, -size, "rule", "verdict")))
    return fits.groupBy("url").agg(longest.alias("host_rule"), first.alias("by_pattern"))


def judge(pages: DataFrame, rules: DataFrame, *, row_key: str = "page_id") -> DataFrame:
    """pages (with `url`) and host, path, rule, pattern (the one that decided, else null) and verdict (allow or block).

    Every distinct URL is judged once. Only URLs that a rule fits are joined back, by themselves; null URLs are spread by `row_key`.
    """
    pages = pages.drop(*RESULT)
    urls = pages.select("url")
    small = (rules.agg(F.sum(F.octet_length("rule") + ROW_BYTES)).first()[0] or 0) <= BROADCAST_BYTES
    best = decided(urls, indexed(rules, urls, small), small).withColumnRenamed("url", "__url")
    spread = F.coalesce("url", F.concat(F.lit("\x00"), F.xxhash64(row_key).cast("string")))
    out = pages.withColumn("__at", spread).join(best, F.col("__at") == F.col("__url"), "left")
    of = F.coalesce("host_rule.verdict", "by_pattern.verdict", F.lit("allow"))
    return out.select(
        *[F.col(f"`{c}`") for c in pages.columns], _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), F.col("host_rule.rule").alias("rule"),
        F.when(F.col("host_rule").isNull(), F.col("by_pattern.rule")).alias("pattern"), of.alias("verdict"),
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the host rules, else by the pattern rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules(spark, HOST_RULES, PATTERN_RULES)).drop("url")
