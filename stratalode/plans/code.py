"""Scans and code facts over the source view of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, matching, offsets, relational
from ..operators.rules import BY_ID
from ..sources import tree
from .corpus import FINDINGS, LINES, read, sources
from .registry import query


def view_files(spark, d):
    src = sources(spark, d).select(F.concat(F.lit("pkg/u"), F.col("user_id"), F.lit(".py")).alias("rel"), "content")
    return tree.from_table(src, "rel", "content")


@query()
def scan_files(spark, d):
    """All 63 rules with every filter over the source view; the matcher runs Python, so SQL has no counterpart."""
    return matching.scan(view_files(spark, d)).select("rel", "rule_id", "severity", "line", "col", "start", "matched_text", "confidence", "tier", "signal_path")


@query(f"select 'pkg/u' || user_id || '.py' as rel, rule_id, line, col, start, matched_text from {FINDINGS} where rule_id in ('QUAL-001', 'SEC-008')")
def scan_two_rules(spark, d):
    """The production matcher on two rules that no filter touches here: the same rows as the Catalyst matcher's."""
    got = matching.scan(view_files(spark, d), [BY_ID["QUAL-001"], BY_ID["SEC-008"]])
    return got.select("rel", "rule_id", "line", "col", "start", "matched_text")


NOTE = """case event_type when 'error' then 'x = 1  # FIXME soon' when 'click' then '# a TODO and a hack' when 'view' then '  // Optimize this; perf' when 'signup' then '# tech-debt' when 'purchase' then 'y = 2' else '# noqa' end"""
MARKER = "coalesce(" + ", ".join(f"nullif(upper(regexp_extract(t, '{p}', 1)), '')" for p, _, _ in detectors.DEBT) + ")"
FIRST = "case " + " ".join(f"when regexp_matches(t, '{p}') then {i}" for i, (p, _, _) in enumerate(detectors.DEBT)) + " end"


@query(f"""select event_id, {MARKER} as marker, c as category, h as hours, left(case when contains(t, '#') then trim(regexp_extract(t, '#\\s*(.*)', 1), ' ') else trim(t, ' ') end, 200) as note
 from (select event_id, {NOTE} as t from events) join (values {', '.join(f"({i}, '{c}', {h}::double)" for i, (_, c, h) in enumerate(detectors.DEBT))}) v(i, c, h) on v.i = {FIRST}""")
def debt_markers(spark, d):
    """Debt markers of lines in any language; the first in the ladder counts."""
    ls = read(spark, d, "events").select("event_id", F.lit(1).cast("long").alias("line"), F.expr(NOTE).alias("text"))
    return detectors.debt(ls, "event_id").select("event_id", "marker", "category", "hours", "note")


@query(f"""select user_id, line, coalesce(last_value(nullif(regexp_extract(line_text, '^password = "(\\w+)"', 1), '') ignore nulls) over (partition by user_id order by line rows between unbounded preceding and 1 preceding), '<module>') as scope from {LINES}""")
def enclosing_scope(spark, d):
    """The last named line strictly above each line."""
    ls = offsets.lines(sources(spark, d), "user_id", "content")
    return relational.enclosing_scope(ls, "user_id", r'^password = "(\w+)"').select("user_id", "line", "scope")


@query("""with n as (select n_nationkey as k, count(c_custkey) as callers from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by 1)
 select k::bigint as k, callers::bigint as callers, callers = 0 as entry from n""")
def entry_points(spark, d):
    """Nodes that nothing points to."""
    e = read(spark, d, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("callers"))
    n = read(spark, d, "nation").join(e, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(F.col("n_nationkey").cast("long").alias("k"), F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callers", F.lit(0)).eqNullSafe(0).alias("entry"))
