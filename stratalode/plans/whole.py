"""Graph, review and drift operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, offsets, relational, rollups
from .corpus import DOC_LINES, FINDINGS, read, view_findings
from .registry import query
from .star import FILES


def trade(spark, d):
    """Nations whose customers bought from nations' suppliers."""
    li, o = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


TRADE = "(select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"
COUPLING = f"""(select n_nationkey, coalesce(ca, 0)::bigint as ca, coalesce(ce, 0)::bigint as ce, case when coalesce(ca, 0) + coalesce(ce, 0) = 0 then 0.5::double else round_even(coalesce(ce, 0)::double / (coalesce(ca, 0) + coalesce(ce, 0)), 2) end as instability
 from nation left join (select src, count(*) as ce from {TRADE} where src <> dst group by 1) on src = n_nationkey left join (select dst, count(*) as ca from {TRADE} where src <> dst group by 1) on dst = n_nationkey)"""


@query(f"select * from {COUPLING}")
def coupling(spark, d):
    return relational.coupling(trade(spark, d), read(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query(f"select n_nationkey, ca, ce, ca * ce as score from {COUPLING} where ca >= 3 and ce >= 3")
def hub_nodes(spark, d):
    return relational.hubs(coupling(spark, d), "n_nationkey")


@query(f"select instability, count(*)::bigint as nodes, min(n_nationkey) as first from {COUPLING} group by 1")
def instability_rank(spark, d):
    return coupling(spark, d).groupBy("instability").agg(F.count(F.lit(1)).alias("nodes"), F.min("n_nationkey").alias("first"))


@query("""with m as (select distinct 's' || s_nationkey as model, 'f' || s_suppkey % 17 as field from supplier), s as (select distinct 's' || c_nationkey as model, 'f' || c_custkey % 19 as field from customer)
 select model, field, 'unused' as kind, 'LOW' as severity from (from m except from s) union all select model, field, 'missing', 'HIGH' from (from s except from m) where model in (select model from m)""")
def schema_drift(spark, d):
    m = read(spark, d, "supplier").selectExpr("concat('s', s_nationkey) as model", "concat('f', s_suppkey % 17) as field")
    return relational.drift(m, read(spark, d, "customer").selectExpr("concat('s', c_nationkey) as model", "concat('f', c_custkey % 19) as field"))


@query("select 'c' || c_custkey as src, 's' || s_suppkey as dst from customer join supplier on c_nationkey = s_nationkey")
def call_resolution(spark, d):
    f = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("qualname"), F.col("s_nationkey").cast("string").alias("name"), F.lit("").alias("rel"))
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("caller"), F.col("c_nationkey").cast("string").alias("callee"), F.lit("").alias("rel"))
    return code.call_edges(f, c, qualified=False)


@query(f"""with l as (select doc_id, line, lower(trim(regexp_replace(regexp_replace(text, '(#|//).*$', ''), '\\s+', ' ', 'g'), ' ')) as t from {DOC_LINES})
 select a.doc_id, a.line, sha256(string_agg(l.t, chr(10) order by l.line)) as context_hash from l a join l on l.doc_id = a.doc_id and l.line between a.line - 5 and a.line + 5 where l.t <> '' group by 1, 2""")
def fingerprint(spark, d):
    """Digest of what surrounds every line of a document."""
    ls = offsets.lines(read(spark, d, "documents"), "doc_id", "text")
    return relational.fingerprints(ls, ls.select("doc_id", "line"), "doc_id")


@query(f"""with c as (select count(*)::bigint as total, count(*) filter (where severity = 'HIGH')::bigint as high, count(*) filter (where severity = 'MEDIUM')::bigint as medium, count(*) filter (where severity = 'LOW')::bigint as low from {FINDINGS}),
 s as (select *, least(greatest(100 - 25 * high - 8 * medium - 2 * low - trunc(8.0::double * total / greatest({FILES}, 1))::bigint, 0), 100)::bigint as score from c)
 select *, concat_ws(',', case when high > 0 then 'high' end, case when medium > 25 then 'medium' end, case when score < 70 then 'score' end) as failures, not (high > 0 or medium > 25 or score < 70) as passed from s""")
def quality_gate(spark, d):
    files = read(spark, d, "events").agg(F.countDistinct("user_id").alias("__files"))
    counts = rollups.severity_counts(view_findings(spark, d)).crossJoin(files)  # one row each
    return rollups.gate(rollups.quality_score(counts, F.col("__files"))).drop("__files")


@query(f"""with c as (select count(*) filter (where severity = 'HIGH')::bigint as high, count(*) filter (where severity = 'MEDIUM')::bigint as medium, count(*) filter (where severity = 'LOW')::bigint as low, count(*) filter (where contains(rule_id, 'SEC-'))::bigint as security,
  sum(case severity when 'HIGH' then 15 when 'MEDIUM' then 10 else 5 end)::bigint as minutes from {FINDINGS}),
 s as (select *, least(greatest(round_even(100 - 5 * high - 2 * medium - 0.5::double * low, 0), 0), 100)::bigint as score, high + security as blockers from c)
 select high, medium, low, security, coalesce(minutes, 0)::bigint as minutes, score, blockers, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade, case when blockers = 0 and score >= 60 then 'GO' else 'NO-GO' end as decision from s""")
def project_review(spark, d):
    return rollups.review(view_findings(spark, d))


@query(f"""with e as materialized (select src, dst from {TRADE} where src <> dst), p2 as (select src as first, dst as last, [src, dst] as path from e where src < dst),
 p3 as (select first, dst as last, list_append(path, dst) as path from p2 join e on last = src where dst > first and not list_contains(path, dst)),
 p4 as (select first, dst as last, list_append(path, dst) as path from p3 join e on last = src where dst > first and not list_contains(path, dst))
 select array_to_string(path, '>') as path, len(path)::int as length from (from p2 union all from p3 union all from p4) semi join e on last = src and first = dst""")
def cycles_len_le_4(spark, d):
    return relational.cycles(trade(spark, d)).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")
