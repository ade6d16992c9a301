"""The relational operators over the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational, rollups
from .corpus import FINDINGS, read, view_findings
from .registry import query

FILES = "(select count(distinct user_id) from events)"


def cochange_sql(source: str, commit: str, path: str, cap: str = "") -> str:
    return f"""with c as (select distinct {commit} as c, {path} as p from {source}), n as (select count(distinct c) as n from c)
 select a.p as a, b.p as b, count(*)::bigint as together, round_even(100.0::double * count(*) / (select n from n), 1) as strength from c a join c b on a.c = b.c and a.p < b.p group by 1, 2 having count(*) >= 3 {cap}"""


@query(cochange_sql("lineitem", "l_orderkey", "l_partkey"))
def cochange_parts(spark, d):
    return relational.cochange(read(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query(cochange_sql("lineitem", "l_orderkey", "l_suppkey", "order by together desc, a, b limit 100"))
def cochange_suppliers(spark, d):
    return relational.cochange(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey").orderBy(F.desc("together"), "a", "b").limit(100)


@query(cochange_sql("(select user_id || ':' || strftime(ts, '%Y-%m-%d') as day, event_type from events)", "day", "event_type"))
def cochange_event_types(spark, d):
    ev = read(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("day"), "event_type")
    return relational.cochange(ev, "day", "event_type")


@query("select user_id || '/' || event_type as path, count(*)::bigint as changes from events where not contains(event_type, 'view') group by 1 order by changes desc, path limit 100")
def hotspots(spark, d):
    ev = read(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"))
    return relational.hotspots(ev, "path", ("view",), 100)


PLACES = "(select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer)"


@query(f"""with recursive b as (select src, dst from {PLACES} union select dst, src from {PLACES}), w as (select 'n3' as node, 0 as level union select dst, level + 1 from w join b on node = src where level < 2)
 select node, min(level)::int as level from w group by 1""")
def impact_2hop(spark, d):
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    e = e.unionByName(c.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey")).alias("dst")))
    return relational.within_hops(e, spark.createDataFrame([("n3",)], "node string"), "node")


@query("select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def dead_nodes(spark, d):
    used = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.dead(read(spark, d, "part").select("p_partkey", "p_name"), used, "p_partkey")


@query("""select k as "key", c::bigint as n_calls, r::bigint as n_routes, case when r = 0 then 'orphan_ui' when c = 0 then 'orphan_backend' else 'wired' end as status,
 case when c > 0 and r > 0 then case when c = 1 and r = 1 then '1:1' when c > 1 then 'many:1' else '1:many' end end as cardinality
 from (select coalesce(a.k, b.k) as k, coalesce(c, 0) as c, coalesce(r, 0) as r from (select o_custkey as k, count(*) as c from orders where o_orderpriority = '1-URGENT' group by 1) a
  full outer join (select c_custkey as k, count(*) as r from customer where c_acctbal > 2000 group by 1) b on a.k = b.k)""")
def orphan_full_outer(spark, d):
    calls = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return relational.wiring(calls, read(spark, d, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("key")), "key")


@query("""with s as (select source, 5.0::double * count(*) as w, 'security' as kind from documents join labels using (doc_id) where toxic = 1 group by 1
 union all select source, 2.0::double * count(*), 'quality' from documents join labels using (doc_id) where quality = 0 group by 1
 union all select source, 1.0::double * count(*), 'churn' from documents where lang <> 'en' group by 1
 union all select source, 1.0::double * count(*), 'duplicates' from documents where text in (select text from documents group by 1 having count(*) > 1) group by 1),
 p as (select source, coalesce(sum(w) filter (where kind = 'security'), 0) as security, coalesce(sum(w) filter (where kind = 'quality'), 0) as quality, 0.0::double as smells, coalesce(sum(w) filter (where kind = 'churn'), 0) as churn, coalesce(sum(w) filter (where kind = 'duplicates'), 0) as duplicates from s group by 1),
 q as (select *, round_even(5 * security + 2 * quality + 2 * smells + 3 * churn + duplicates, 1) as score from p)
 select *, case when score / (select case when max(score) > 0 then max(score) else 1 end from q) > 0.6 then 'high' when score / (select case when max(score) > 0 then max(score) else 1 end from q) > 0.2 then 'medium' else 'low' end as band from q""")
def risk_heatmap(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest")), read(spark, d, "labels")
    marked = docs.join(labels, "doc_id")
    sig = lambda df, kind, w: df.select("source", F.lit(kind).alias("kind"), F.lit(w).alias("weight"))
    twice = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    signals = sig(marked.where("toxic = 1"), "security", 5.0).unionByName(sig(marked.where("quality = 0"), "quality", 2.0)).unionByName(sig(docs.where("lang != 'en'"), "churn", 1.0))
    return rollups.heatmap(signals.unionByName(sig(docs.join(twice, "digest", "left_semi"), "duplicates", 1.0)), "source")


@query("""with f as (select source, doc_id, case when toxic = 1 then 5.0::double when quality = 0 then 2.0 else 0.5 end as w from documents join labels using (doc_id)),
 u as (select source, count(distinct doc_id)::bigint as items, sum(w) as weighted, sum(w) / count(distinct doc_id) * 100 as per_100 from f group by 1)
 select *, case when per_100 <= 5 then 'A' when per_100 <= 15 then 'B' when per_100 <= 40 then 'C' when per_100 <= 80 then 'D' else 'F' end as grade,
 trunc(greatest(case when per_100 <= 5 then 100 - per_100 when per_100 <= 15 then 100 - per_100 * 0.8::double when per_100 <= 40 then 100 - per_100 * 0.6::double when per_100 <= 80 then greatest(20.0::double, 100 - per_100 * 0.5::double) else greatest(5.0::double, 100 - per_100 * 0.4::double) end, 0))::bigint as score from u""")
def module_cards(spark, d):
    f = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    f = f.withColumn("severity", F.when(F.col("toxic") == 1, "HIGH").when(F.col("quality") == 0, "MEDIUM").otherwise("LOW"))
    return rollups.module_cards(f, "source", "doc_id")


SEVERITY = "case o_orderpriority when '1-URGENT' then 'HIGH' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' when '5-LOW' then 'LOW' else 'NONE' end"


@query(f"""with t as (select o_orderkey, {SEVERITY} as severity from orders), m as (select *, case severity when 'HIGH' then 15 when 'MEDIUM' then 5 else 10 end as minutes, case severity when 'HIGH' then 10 when 'MEDIUM' then 4 when 'LOW' then 1 else 2 end as impact from t),
 r as (select minutes, sum(minutes) over (order by round_even(impact::double / minutes, 2) desc, severity, o_orderkey rows unbounded preceding) as running from m)
 select case when running <= 240 then 'now' when running <= 480 then 'next' when running <= 960 then 'later' else 'backlog' end as batch, count(*)::bigint as tasks, sum(minutes)::bigint as minutes from r group by 1""")
def sprint_batches(spark, d):
    """Tasks and minutes of each batch, from one row a severity instead of a running sum over all rows."""
    return rollups.batch_totals(read(spark, d, "orders").selectExpr(f"{SEVERITY} as severity")).where("tasks > 0")


@query("""with v as (select source, count(*)::bigint as votes, count(*) filter (where quality = 1)::bigint as useful from documents join labels using (doc_id) group by 1 having count(*) >= 3)
 select *, round_even(useful::double / votes, 2) as useful_ratio, round_even((votes - useful)::double / votes, 2) as noisy_ratio,
 case when round_even((votes - useful)::double / votes, 2) >= 0.7 then 'suppress' when round_even(useful::double / votes, 2) >= 0.7 then 'keep' else 'review' end as advice from v""")
def feedback_insights(spark, d):
    v = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return rollups.feedback(v, "source", F.col("quality") == 1)


@query("""with b as (select doc_id, quality, toxic, (1 - case when toxic = 1 then 0.3::double else 0.15::double end) * (case when quality = 1 then 1.15::double else 1.0::double end) * (case when doc_id % 2 = 0 then 1.10::double else 1.0::double end)
  * (case when doc_id % 3 = 0 then 1.0::double when doc_id % 3 = 1 then 1.20::double else 0.60::double end) * (case when doc_id % 5 = 0 then 0.70::double else 1.0::double end) * (case when doc_id % 7 = 0 then 0.40::double else 1.0::double end) as c from labels)
 select doc_id, quality, toxic, round_even(least(greatest(case when doc_id % 4 = 0 then 0.7::double * c + 0.3::double * (doc_id % 10 / 10.0::double) else c end, 0.05), 0.99), 4) as confidence from b""")
def confidence_calibrate(spark, d):
    i = F.col("doc_id")
    return rollups.calibrate(
        read(spark, d, "labels").select("doc_id", "quality", "toxic"), F.when(F.col("toxic") == 1, 0.3), F.col("quality") == 1, i % 2 == 0, F.when(i % 3 == 1, True).when(i % 3 == 2, False),
        i % 5 == 0, i % 7 == 0, F.when(i % 4 == 0, (i % 10) / 10.0),
    )


@query(f"select coalesce(sum(m), 0)::bigint as minutes, round_even(coalesce(sum(m), 0) / 60.0::double, 1) as hours from (select case when starts_with(rule_id, 'SEC-') then 15 when starts_with(rule_id, 'QUAL-') then 5 else 10 end as m from {FINDINGS})")
def remediation_time(spark, d):
    return rollups.remediation(view_findings(spark, d))


@query("select source, sum((lang = 'en')::int)::bigint as covered, count(*)::bigint as total, trunc(100.0::double * sum((lang = 'en')::int) / count(*))::bigint as pct from documents group by 1")
def coverage_pct(spark, d):
    g = read(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("covered"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("pct", rollups.percent(F.col("covered"), F.col("total")))


@query("select d.lang, regexp_extract(p.html, 'lang=\"([a-z]+)\"', 1) as declared, count(*)::bigint as n from documents d join pages p on d.doc_id = p.page_id group by 1, 2")
def lang_confusion(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("declared"))
    return read(spark, d, "documents").select("doc_id", "lang").join(p, "doc_id").groupBy("lang", "declared").agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey, regexp_replace(s_name, '[^0-9A-Za-z_]', '_', 'g')[1:40] as id, (string_split(s_acctbal::varchar, '.')[1]) as whole, (case when starts_with(s_acctbal::varchar, '-') then false else s_acctbal >= 1000 end) as big from supplier")
def safe_ids(spark, d):
    s = read(spark, d, "supplier")
    whole = F.element_at(F.split(F.col("s_acctbal").cast("string"), r"\."), 1)
    return s.select("s_suppkey", X.safe_id(F.col("s_name")).alias("id"), whole.alias("whole"), X.version_at_least(whole, F.lit("1000")).alias("big"))


@query("""with recursive s as (select user_id, event_id, ts, event_type, lag(event_type) over (partition by user_id order by event_id) as prev from events)
 select user_id, event_id, case when prev is null then 'created' when event_type = 'error' then 'deleted' when prev = 'error' then 'created' when event_type <> prev then 'modified' end as change from s
 where prev is null or event_type <> prev""")
def watch_changes(spark, d):
    """Changes between the states of each file that the event log replays, by the batch form of the stream operator."""
    from ..streaming.changes import from_log

    ev = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("digest"), (F.col("event_type") == "error").alias("gone"))
    return from_log(ev, "user_id", "event_id")
