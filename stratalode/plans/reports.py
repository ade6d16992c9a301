"""Reports over the source view and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import offsets, relational, reports
from .corpus import DOC_LINES, FINDINGS, LINES, SOURCES, read, sources, view_findings
from .registry import query
from .star import FILES
from .whole import COUPLING, TRADE, coupling, trade

MARKED = f"(select *, line % 3 = 0 as llm_suppressed from {FINDINGS})"


def marked(spark, d):
    return view_findings(spark, d).withColumn("llm_suppressed", F.col("line") % 3 == 0)


@query(f"""select count(*)::bigint as total, count(*) filter (not llm_suppressed)::bigint as active, count(*) filter (llm_suppressed)::bigint as suppressed, {', '.join(f"count(*) filter (not llm_suppressed and severity = '{s.upper()}')::bigint as {s}" for s in ('critical', 'high', 'medium', 'low'))} from {MARKED}""")
def pipeline_summary(spark, d):
    return reports.pipeline_summary(marked(spark, d))


@query(f"select rule_id, user_id, line, col from {MARKED} where not llm_suppressed")
def active_findings(spark, d):
    return reports.split_suppressed(marked(spark, d))[0].select("rule_id", "user_id", "line", "col")


@query(f"""select penalty, score, case when score >= 90 then 'A' when score >= 70 then 'B' when score >= 50 then 'C' when score >= 30 then 'D' else 'F' end as grade
 from (select penalty, greatest(100 - (penalty * 100) // (greatest(n, 1) * 10), 0)::bigint as score from (select sum(case severity when 'HIGH' then 10 when 'MEDIUM' then 3 else 1 end)::bigint as penalty, {FILES} * 40 as n from {FINDINGS}))""")
def overall_grade(spark, d):
    n = read(spark, d, "events").select("user_id").distinct().count() * 40
    return reports.overall_grade(view_findings(spark, d), F.lit(n))


@query(f"""select doc_id, count(*)::bigint as lines, count(*) filter (regexp_matches(text, '^\\s*(?:async\\s+)?def\\s+\\w+'))::bigint as functions, count(*) filter (regexp_matches(text, '^\\s*class\\s+\\w+'))::bigint as classes,
 count(*) filter (regexp_matches(text, '^\\s*(?:import|from)\\s+'))::bigint as imports from {DOC_LINES} group by 1""")
def element_counts(spark, d):
    return reports.elements(offsets.lines(read(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"select dst as module, count(*)::bigint as dependents from {TRADE} group by 1 having count(*) >= 5 order by dependents desc, module limit 10")
def god_modules(spark, d):
    return reports.god_modules(trade(spark, d))


HEALTH = f"""(select *, case when ce <= 2 and n_functions <= 8 then 'high' when ce <= 5 then 'medium' else 'low' end as cohesion,
 case when ca >= 5 and ce >= 5 then 'god_module' when instability > 0.8 and ca >= 3 then 'fragile' when ca = 0 and ce = 0 and n_lines > 20 then 'isolated' when ce > 8 then 'dependent' else 'healthy' end as health
 from (select *, n_nationkey::bigint % 13 as n_functions, n_nationkey::bigint * 5 as n_lines from {COUPLING}))"""


@query(f"select n_nationkey, ca, ce, instability, n_functions, n_lines, cohesion, health from {HEALTH}")
def coupling_health(spark, d):
    df = coupling(spark, d).withColumns({"n_functions": F.col("n_nationkey").cast("long") % 13, "n_lines": F.col("n_nationkey").cast("long") * 5})
    return reports.coupling_health(df)


@query(f"""select count(*)::bigint as modules, round_even(avg(instability), 2) as avg_instability, {', '.join(f"count(*) filter (health = '{n}')::bigint as {n}" for n in ('healthy', 'god_module', 'fragile', 'isolated', 'dependent'))} from {HEALTH}""")
def coupling_summary(spark, d):
    return reports.coupling_summary(coupling_health(spark, d))


@query("select s_suppkey, s_name as name, exists (select 1 from customer where contains('tests/test_' || c_custkey || '.py', s_suppkey::varchar)) as has_test from supplier")
def has_test(spark, d):
    f = read(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("name"), F.col("s_name").alias("shown"))
    t = read(spark, d, "customer").select(F.concat(F.lit("tests/test_"), F.col("c_custkey"), F.lit(".py")).alias("rel"))
    return reports.has_test(f, t).select("s_suppkey", F.col("shown").alias("name"), "has_test")


KEYS = f"""(with l as (select user_id, line, line_text, coalesce(last_value(nullif(regexp_extract(line_text, '^password = "(\\w+)"', 1), '') ignore nulls) over (partition by user_id order by line rows between unbounded preceding and 1 preceding), '<module>') as scope from {LINES}),
 o as (select *, count(*) over (partition by user_id, scope, trim(line_text, ' ') order by line rows between unbounded preceding and current row) as occurrence from l),
 t as (select user_id, line, lower(trim(regexp_replace(regexp_replace(line_text, '(#|//).*$', ''), '\\s+', ' ', 'g'), ' ')) as t from l),
 h as (select a.user_id, a.line, sha256(string_agg(t.t, chr(10) order by t.line)) as context_hash from l a join t on t.user_id = a.user_id and t.line between a.line - 5 and a.line + 5 where t.t <> '' group by 1, 2)
 select f.user_id, f.rule_id, f.line, f.col, f.rule_id || ':' || context_hash[1:12] || ':' || scope || ':' || occurrence as key from {FINDINGS} f join o using (user_id, line) join h using (user_id, line))"""


def keyed(spark, d):
    """Findings of the source view with their fingerprint keys."""
    ls = offsets.lines(sources(spark, d), "user_id", "content")
    at = view_findings(spark, d).select("user_id", "rule_id", "line", "col")
    hashes = relational.fingerprints(ls, at.select("user_id", "line").distinct(), "user_id")
    scoped = relational.nth_occurrence(relational.enclosing_scope(ls, "user_id", r'^password = "(\w+)"'), "user_id", "scope")
    df = at.join(hashes, ["user_id", "line"]).join(scoped.select("user_id", "line", "scope", "occurrence"), ["user_id", "line"])
    key = reports.fingerprint_key(F.col("rule_id"), F.col("context_hash"), F.col("scope"), F.col("occurrence"))
    return df.select("user_id", "rule_id", "line", "col", key.alias("key"))


@query(f"with k as {KEYS} select user_id, rule_id, line, col, key from k where key in (select key from k where rule_id = 'PY-004' or line <= 20)")
def previously_fixed(spark, d):
    """Findings of the view whose fingerprint is that of a fix on record: here every print, and what stands on the first lines."""
    k = keyed(spark, d)
    return reports.previously_fixed(k, k.where("rule_id = 'PY-004' or line <= 20"))


@query(f"with k as {KEYS}, f as (select key, max(line) as fixed_at, rule_id || ' fixed' as fix from k where line <= 20 group by key, rule_id) select user_id, k.rule_id, line, col, key, fixed_at, fix from k join f using (key)")
def regressions(spark, d):
    """Findings that came back after a fix on record, with that record."""
    k = keyed(spark, d)
    fixes = k.where("line <= 20").select("key", F.col("line").alias("fixed_at"), F.concat("rule_id", F.lit(" fixed")).alias("fix"))
    return reports.regressions(k, fixes)


@query("select count(*)::bigint as total, count(*) filter (event_type in ('click', 'view'))::bigint as true_positives, count(*) filter (event_type not in ('click', 'view'))::bigint as false_positives, count(distinct user_id)::bigint as rules from events")
def feedback_stats(spark, d):
    return reports.feedback_stats(read(spark, d, "events"), "user_id", F.col("event_type").isin("click", "view"))


ANSWER = """case event_type when 'error' then 'Verdict: false positive' || chr(10) || 'reason: in a: test ' when 'click' then 'VERDICT: TRUE_POSITIVE' || chr(10) || 'VERDICT: unsure' || chr(10) || '  REASON: x' || chr(10) || 'Reason: y'
 when 'view' then 'no idea' else 'VERDICT: FALSE_POSITIVE' || chr(10) || 'VERDICT: TRUE POSITIVE' end"""


@query(f"""with l as (select event_id, i, trim(x, ' ') as x from (select event_id, unnest(string_split(a, chr(10))) as x, unnest(range(len(string_split(a, chr(10))))) as i from (select event_id, {ANSWER} as a from events))),
 v as (select event_id, i, case when regexp_matches(upper(x), 'FALSE[_ ]POSITIVE') then 'FALSE_POSITIVE' when regexp_matches(upper(x), 'TRUE[_ ]POSITIVE') then 'TRUE_POSITIVE' end as verdict from l where starts_with(upper(x), 'VERDICT:')),
 r as (select event_id, arg_max(trim(x[strpos(x, ':') + 1:], ' '), i) as reason from l where starts_with(upper(x), 'REASON:') group by 1),
 w as (select event_id, arg_max(verdict, i) as verdict from v where verdict is not null group by 1)
 select event_id, coalesce(verdict, '') as verdict, coalesce(reason, '') as reason from events left join w using (event_id) left join r using (event_id)""")
def verdicts(spark, d):
    """Verdict and reason cut out of a model's answers."""
    verdict, reason = reports.parse_verdict(F.col("a"))
    return read(spark, d, "events").select("event_id", F.expr(ANSWER.replace("chr(", "char(")).alias("a")).select("event_id", verdict.alias("verdict"), reason.alias("reason"))


@query("""select user_id, array_to_string(list_sort(list_distinct(list('s' || event_id % 7))), ',') as sources, array_to_string(list_sort(list_distinct(list(event_type))), ',') as sinks, array_to_string(list_sort(list_distinct(list('z' || event_id % 3))), ',') as sanitizers from events group by 1""")
def taint_specs(spark, d):
    e = read(spark, d, "events")
    one = lambda x: F.array(x.cast("string"))
    specs = e.select("user_id", one(F.concat(F.lit("s"), F.col("event_id") % 7)).alias("sources"), one(F.col("event_type")).alias("sinks"), one(F.concat(F.lit("z"), F.col("event_id") % 3)).alias("sanitizers"))
    merged = reports.merge_specs(specs, "user_id")
    return merged.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("sources", "sinks", "sanitizers")])


@query(f"select rule_id, user_id, line, col, (row_number() over (order by rule_id, user_id, line, col) - 1) // 10 as batch from {FINDINGS} where severity = 'HIGH' qualify batch < 50")
def model_batches(spark, d):
    """Findings of high severity in the batches of ten in which a model is asked about them, 50 calls at most."""
    return reports.model_batches(view_findings(spark, d).select("rule_id", "severity", "user_id", "line", "col"), ["user_id", "line", "col"]).drop("severity")


@query(f"""select coalesce(a.rule_id, b.rule_id) as rule_id, coalesce(l, 0)::bigint as left, coalesce(r, 0)::bigint as right, coalesce(l, 0) = coalesce(r, 0) as agree from (select rule_id, count(*) as l from {FINDINGS} where rule_id <> 'PY-004' group by 1) a
 full join (select rule_id, count(*) as r from {FINDINGS} where rule_id <> 'SEC-008' and (rule_id <> 'SEC-007' or line > 1) group by 1) b on a.rule_id = b.rule_id""")
def engine_counts(spark, d):
    """Counts by rule of two engines, each of which lacks rules of the other."""
    f = view_findings(spark, d)
    return reports.compare_counts(f.where("rule_id != 'PY-004'"), f.where("rule_id != 'SEC-008' and (rule_id != 'SEC-007' or line > 1)"))


@query(f"select user_id, md5(content[1:65536]) as digest from {SOURCES}")
def head_digests(spark, d):
    """Digests by which a watcher tells whether files changed (the view is ASCII)."""
    return sources(spark, d).select("user_id", reports.head_md5(F.col("content")).alias("digest"))
