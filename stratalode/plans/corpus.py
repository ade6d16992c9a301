"""Queries over texts: rule matches with positions, suppression, duplicates, digests, and the sources built from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import offsets, relational, rollups
from ..operators.rules import BY_ID
from .registry import query

SECRET = BY_ID["SEC-008"][3]
#: Rules of the source view: id, severity, pattern.
VIEW_RULES = [("PY-004", "LOW", r"print\s*\("), ("QUAL-001", "MEDIUM", r"except\s*:"), ("SEC-007", "HIGH", r"\b(eval|exec)\s*\("), ("SEC-008", "MEDIUM", SECRET)]


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_matches(table: str, key: str, text: str, pattern: str) -> str:
    """DuckDB for matches(): the pieces between matches and the matches alternate."""
    p = sql_text(pattern)
    return f"""
    (with a as (select {key} as key, {text} as t, regexp_split_to_array({text}, {p}) as b, regexp_extract_all({text}, {p}) as f from {table} where regexp_matches({text}, {p})),
    e as (select key, t, b, f, unnest(range(len(f))) as i from a),
    s as (select key, t, f[i + 1] as matched_text, (coalesce(list_sum(list_transform(b[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i], lambda x: length(x))), 0))::bigint as start from e)
    select key as {key}, matched_text, start, (length(t[1:start]) - length(replace(t[1:start], chr(10), '')) + 1)::bigint as line,
      (start - coalesce(length(t[1:start]) - length(list_extract(string_split(t[1:start], chr(10)), -1)), 0) + 1)::bigint as col from s)"""


@query("select * from " + sql_matches("documents", "doc_id", "text", SECRET))
def rule_match_secret(spark, d):
    return offsets.matches(read(spark, d, "documents"), "doc_id", "text", SECRET)


@query("select * from " + sql_matches("documents", "doc_id", "text", "(?m)^.{200,}$"))
def rule_match_long_line(spark, d):
    return offsets.matches(read(spark, d, "documents"), "doc_id", "text", "(?md)^.{200,}$")


@query("select page_id, len(regexp_extract_all(html, 'var\\s+\\w+'))::bigint as n from pages where regexp_matches(html, 'var\\s+\\w+')")
def rule_match_var(spark, d):
    n = F.regexp_count("html", F.lit(BY_ID["JS-QUAL-005"][3]))
    return read(spark, d, "pages").select("page_id", n.cast("long").alias("n")).where("n > 0")


LINE = """case event_type when 'error' then 'except:' when 'click' then 'x = eval(data)  # exec(later)' when 'view' then '# print(eval(x))'
 when 'signup' then 'password = "p' || event_id::varchar || '"' else 'print("eval(" + name)' end"""


def sources(spark, d: str) -> DataFrame:
    """A source view of events: one file a user, one line an event."""
    line = (
        F.when(F.col("event_type") == "error", "except:").when(F.col("event_type") == "click", "x = eval(data)  # exec(later)").when(F.col("event_type") == "view", "# print(eval(x))")
        .when(F.col("event_type") == "signup", F.concat(F.lit('password = "p'), F.col("event_id").cast("string"), F.lit('"'))).otherwise('print("eval(" + name)')
    )
    rows = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"))
    return rows.select("user_id", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("content"))


SOURCES = f"(select user_id, string_agg({LINE}, chr(10) order by event_id) as content from events group by 1)"


def view_findings(spark, d: str) -> DataFrame:
    src = sources(spark, d)
    parts = [offsets.matches(src, "user_id", "content", p).select(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), "user_id", "start", "line", "col", "matched_text") for r, s, p in VIEW_RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FINDINGS = "(" + " union all ".join(f"select '{r}' as rule_id, '{s}' as severity, user_id, start, line, col, matched_text from {sql_matches(SOURCES, 'user_id', 'content', p)}" for r, s, p in VIEW_RULES) + ")"


@query(f"select * from {FINDINGS}")
def source_findings(spark, d):
    return view_findings(spark, d)


@query(f"select count(*)::bigint as total, count(*) filter (where severity = 'HIGH')::bigint as high, count(*) filter (where severity = 'MEDIUM')::bigint as medium, count(*) filter (where severity = 'LOW')::bigint as low from {FINDINGS}")
def finding_severity_summary(spark, d):
    return rollups.severity_counts(view_findings(spark, d))


def with_lines(spark, d: str) -> DataFrame:
    src = offsets.lines(sources(spark, d), "user_id", "content").withColumnRenamed("text", "line_text")
    return view_findings(spark, d).join(src, ["user_id", "line"])


LINES = f"(select user_id, unnest(string_split(content, chr(10))) as line_text, unnest(range(len(string_split(content, chr(10)))))::bigint + 1 as line from {SOURCES})"


@query(f"""select rule_id, user_id, line, col from {FINDINGS} join {LINES} using (user_id, line)
 where not (contains(line_text[1:col - 1], '#') or (length(line_text[1:col - 1]) - length(replace(line_text[1:col - 1], '"', ''))) % 2 = 1)""")
def noncode_suppressed(spark, d):
    """Findings that start in code: neither in a comment nor between quotes."""
    before = F.expr("substring(line_text, 1, cast(col - 1 as int))")
    quotes = F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))
    return with_lines(spark, d).where(~(before.contains("#") | (quotes % 2 == 1))).select("rule_id", "user_id", "line", "col")


def marks(spark, d: str) -> DataFrame:
    """Every 40th event opens an ignored stretch of its user's file, every 40th after 20 closes one."""
    at = Window.partitionBy("user_id").orderBy("event_id")
    ev = read(spark, d, "events").select("user_id", "event_id", F.row_number().over(at).cast("long").alias("line"))
    return ev.where(F.col("event_id") % 40 < 2).select("user_id", "line", (F.col("event_id") % 40 == 0).alias("opens"))


@query(f"""with recursive m as (select user_id, line, event_id % 40 = 0 as opens, row_number() over (partition by user_id order by line) as k from
   (select user_id, event_id, row_number() over (partition by user_id order by event_id)::bigint as line from events) where event_id % 40 < 2),
 walk as (select user_id, line, k, (case when opens then [line] else [] end)::bigint[] as stack, null::bigint as first, null::bigint as last from m where k = 1
   union all select m.user_id, m.line, m.k, case when m.opens then list_append(w.stack, m.line) else w.stack[1:greatest(len(w.stack) - 1, 0)] end,
     case when not m.opens and len(w.stack) > 0 then w.stack[len(w.stack)] end, case when not m.opens and len(w.stack) > 0 then m.line end from walk w join m on m.user_id = w.user_id and m.k = w.k + 1),
 open_ as (select user_id, unnest(stack) as first, 1000000000::bigint as last from walk w where k = (select max(k) from m where m.user_id = w.user_id)),
 spans as (select user_id, first, last from walk where first is not null union all select * from open_)
 select rule_id, user_id, line, col from {FINDINGS} f where not exists (select 1 from spans s where s.user_id = f.user_id and f.line between s.first and s.last)""")
def interval_suppression(spark, d):
    """Findings outside ignored stretches, which nest; a close without an open one counts for nothing, an open one without close runs on."""
    m = marks(spark, d)
    level = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(Window.partitionBy("user_id").orderBy("line"))
    low = F.least(F.min("level").over(Window.partitionBy("user_id").orderBy("line")), F.lit(0))
    prev = F.lag("low", 1, 0).over(Window.partitionBy("user_id").orderBy("line"))
    m = m.withColumn("level", level).withColumn("low", low).withColumn("stray", ~F.col("opens") & (F.col("low") < prev)).where("not stray")
    spans = relational.range_marks(m, ["user_id"], "line", F.col("opens"), F.lit(1_000_000_000))
    return relational.outside_intervals(view_findings(spark, d), spans, ["user_id"], "line", "first", "last").select("rule_id", "user_id", "line", "col")


@query(f"select rule_id, user_id, line from {FINDINGS} where not (user_id % 3 = 0 and rule_id in ('SEC-003', 'SEC-007', 'SEC-009', 'SEC-012', 'SEC-014'))")
def policy_filter(spark, d):
    """The balanced policy, with every third user's file as a test path."""
    from ..operators.filters import policy

    rel = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("pkg/tests/u"), F.col("user_id"), F.lit(".py"))).otherwise(F.concat(F.lit("pkg/u"), F.col("user_id"), F.lit(".py")))
    return policy(view_findings(spark, d).withColumn("rel", rel)).select("rule_id", "user_id", "line")


BEFORE = "ts < timestamp '2024-01-16'"


@query(f"select distinct user_id, event_type, props from events a where not ({BEFORE}) and not exists (select 1 from events b where {BEFORE.replace('ts', 'b.ts')} and a.user_id = b.user_id and a.event_type = b.event_type and a.props = b.props)")
def baseline_new(spark, d):
    ev = read(spark, d, "events")
    keys = ["user_id", "event_type", "props"]
    return relational.new_against(ev.where(f"not ({BEFORE})").select(*keys).distinct(), ev.where(BEFORE), keys)


@query(f"select distinct user_id, event_type, props from events a where {BEFORE} and not exists (select 1 from events b where not ({BEFORE.replace('ts', 'b.ts')}) and a.user_id = b.user_id and a.event_type = b.event_type and a.props = b.props)")
def baseline_resolved(spark, d):
    ev = read(spark, d, "events")
    keys = ["user_id", "event_type", "props"]
    return relational.new_against(ev.where(BEFORE).select(*keys).distinct(), ev.where(f"not ({BEFORE})"), keys)


@query(f"""with o as (select distinct user_id, event_type, props from events where {BEFORE}), n as (select distinct user_id, event_type, props from events where not ({BEFORE}))
 select (select count(*) from (from n except from o))::bigint as "new", (select count(*) from (from o except from n))::bigint as resolved, (select count(*) from (from o intersect from n))::bigint as unchanged,
 (select count(*) from events where {BEFORE})::bigint as old_total, (select count(*) from events where not ({BEFORE}))::bigint as new_total""")
def snapshot_compare(spark, d):
    ev = read(spark, d, "events")
    return relational.compare(ev.where(BEFORE), ev.where(f"not ({BEFORE})"), ["user_id", "event_type", "props"])


DOC_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10)))))::bigint + 1 as line from documents)"


@query(f"""with c as (select doc_id, line, trim(text, ' ') as t from {DOC_LINES} where trim(text, ' ') <> '' and not starts_with(trim(text, ' '), '#')),
 n as (select *, row_number() over (partition by doc_id order by line) - 1 as dense from c),
 b as (select doc_id, line, dense, list(t) over (partition by doc_id order by line rows between current row and 5 following) as l from n),
 h as (select doc_id, line, dense, sha256(array_to_string(l, chr(10))) as digest from b where len(l) = 6)
 select digest, count(*)::bigint as occurrences, count(distinct doc_id)::bigint as keys, min(struct_pack(a := doc_id, b := dense, c := line)).a as first_key, min(struct_pack(a := doc_id, b := dense, c := line)).c as first_line
 from h group by 1 having count(*) >= 2 and (count(distinct doc_id) > 1 or max(dense) - min(dense) >= 6)""")
def duplicate_blocks(spark, d):
    return relational.duplicate_blocks(offsets.lines(read(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"""select doc_id, line, count(*) over (partition by doc_id, trim(text, ' ') order by line rows unbounded preceding)::bigint as occurrence from {DOC_LINES}""")
def nth_occurrence(spark, d):
    ls = offsets.lines(read(spark, d, "documents"), "doc_id", "text").withColumn("scope", F.lit("<module>"))
    return relational.nth_occurrence(ls, "doc_id", "scope").select("doc_id", "line", "occurrence")


WORD = "[^a-zA-Z]+"


@query(f"""with w as (select distinct unnest(regexp_split_to_array(text, '{WORD}')) as word from documents),
 c as (select word, unnest(string_split(word, '')) as ch from w where length(word) >= 8), n as (select word, ch, count(*) as k from c where ch <> '' group by 1, 2)
 select word, round_even(-sum(k::double / length(word) * log2(k::double / length(word))), 6) as bits from n group by word""")
def entropy_tokens(spark, d):
    """Entropy of every distinct word of 8 letters or more."""
    words = read(spark, d, "documents").select(F.explode(F.split("text", WORD)).alias("word")).where("length(word) >= 8").distinct()
    return words.select("word", F.bround(X.entropy(F.col("word")), 6).alias("bits"))


@query("""select page_id, regexp_replace(case when b = '' then '/' else b end, '<[^>]+>|:\\w+|\\{[^}]+\\}', '_PARAM_', 'g') as route, lower(regexp_replace(url, '/+$', '').split('?')[1]) as key
 from (select page_id, url, regexp_replace(regexp_replace(url, '(?s)\\?.*$', ''), '/+$', '') as b from pages)""".replace("lower(regexp_replace(url, '/+$', '').split('?')[1])", "lower(regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '(?s)\\?.*$', ''), '<(\\w+)(?::\\w+)?>|:(\\w+)|\\{(\\w+)\\}', '_PARAM_', 'g'))"))
def route_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", X.route(F.col("url")).alias("route"), X.route_key(F.col("url")).alias("key"))


HREF = 'href="([^"]*)"'


@query(f"select page_id, link, count(*)::bigint as n from (select page_id, unnest(regexp_extract_all(html, {sql_text(HREF)}, 1)) as link from pages) group by 1, 2")
def link_extract(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select page_id, len(regexp_extract_all(html, '\\bdocument\\.write\\b|\\beval\\s*\\(|<script\\s+src\\s*=\\s*["'']http:')) as high, len(regexp_extract_all(html, '\\binnerHTML\\s*=|\\bvar\\s+')) as medium,
 len(regexp_extract_all(html, 'console\\.(log|debug|info|warn|error)\\s*\\(|!important')) as low from pages) select page_id, high::bigint as high, medium::bigint as medium, low::bigint as low from s where high + medium + low > 0""")
def web_smells(spark, d):
    from ..operators.detectors import web_counts

    return web_counts(read(spark, d, "pages"), "page_id", "html")


@query(f"""select rule_id, min(k)::bigint as first_seen, count(*)::bigint as results, row_number() over (order by min(k)) - 1 as rule_index, max(level) as level from
 (select rule_id, row_number() over (order by user_id, line, col, rule_id) as k, case severity when 'HIGH' then 'error' when 'MEDIUM' then 'warning' when 'LOW' then 'note' else 'warning' end as level from {FINDINGS}) group by 1""")
def sarif_rules(spark, d):
    """The rule list of a SARIF run: rules by first result, with index and level."""
    from ..operators.sinks import sarif_level

    f = view_findings(spark, d)
    first = f.groupBy("rule_id").agg(F.min(F.struct("user_id", "line", "col", "rule_id")).alias("at"), F.count(F.lit(1)).alias("results"), F.first(sarif_level(F.col("severity"))).alias("level"))
    before = F.broadcast(first.select(F.col("rule_id").alias("r"), "at"))  # one row a rule
    rank = f.select(F.struct("user_id", "line", "col", "rule_id").alias("k")).join(before, F.col("k") <= F.col("at")).groupBy("r").agg(F.count(F.lit(1)).alias("first_seen"))
    out = first.join(rank, F.col("rule_id") == F.col("r"))
    return out.select("rule_id", "first_seen", "results", (F.row_number().over(Window.orderBy("first_seen")) - 1).cast("long").alias("rule_index"), "level")
