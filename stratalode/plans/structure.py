"""Circular structure, batches of work item by item, and names within texts, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import code, connections, graph, interfaces, rollups
from ..sources import tree
from .corpus import FINDINGS, read, view_findings
from .registry import query


def _next_customer(spark, d, largest: bool):
    """An edge from each customer to the one whose order, by number, follows their largest or smallest order."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    own = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice") if largest else F.asc("o_totalprice"), "o_orderkey")
    picked = o.withColumn("rank", F.row_number().over(own)).where("rank = 1")
    follower = o.select((F.col("o_orderkey") - 1).alias("before"), F.col("o_custkey").alias("dst"))
    return picked.join(follower, F.col("o_orderkey") == F.col("before")).select(F.col("o_custkey").alias("src"), "dst")


def _next_sql(largest: bool) -> str:
    return f"""select p.o_custkey as src, f.o_custkey as dst from (select o_custkey, arg_min(o_orderkey, {{'a': {'-' if largest else ''}o_totalprice, 'b': o_orderkey}}) as k from orders group by 1) p join orders f on f.o_orderkey = p.k + 1"""


@query(f"""with recursive e as (select distinct src, dst from ({_next_sql(True)} union all {_next_sql(False)}) where src <> dst), r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src),
 c as (select a.src as node, min(a.dst) as component from r a join r b on a.src = b.dst and a.dst = b.src group by 1)
 select node, component, count(*) over (partition by component)::bigint as size from c""")
def call_components(spark, d):
    """Strongly connected components of a graph with two edges a node."""
    return graph.components(_next_customer(spark, d, True).unionByName(_next_customer(spark, d, False)))


@query(f"""with recursive e as (select distinct src, dst from ({_next_sql(True)}) where src <> dst),
 p as (select src as first, dst as last, [src, dst] as path from e where src < dst union all select first, dst, list_append(path, dst) from p join e on last = src where dst > first and not list_contains(path, dst))
 select array_to_string(path, '>') as path, len(path)::int as length from p semi join e on last = src and first = dst""")
def circular_calls(spark, d):
    """Every cycle of a graph with one edge a node, however long."""
    return graph.circular(_next_customer(spark, d, True)).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


ITEMS = f"""(select 'finding' as type, rule_id as id, user_id as rel, line, start as pos, severity, case when starts_with(rule_id, 'SEC-') then 15 when starts_with(rule_id, 'QUAL-') then 5 else 10 end as minutes,
  case severity when 'HIGH' then 10 when 'MEDIUM' then 4 when 'LOW' then 1 else 2 end as impact from {FINDINGS}
 union all select 'smell', 'toxic', doc_id, 1, 0, case when quality = 1 then 'MEDIUM' else 'HIGH' end, 15, case when quality = 1 then 3 else 8 end from labels where toxic = 1)"""


def _items(spark, d):
    f = view_findings(spark, d).withColumnRenamed("user_id", "rel")
    s = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("rel"), F.lit(1).cast("long").alias("line"), F.lit("toxic").alias("smell"), F.when(F.col("quality") == 1, "MEDIUM").otherwise("HIGH").alias("severity"))
    return rollups.action_items(f, s)


BATCHED = f"""(select *, case when running <= 240 then 'now' when running <= 480 then 'next' when running <= 960 then 'later' else 'backlog' end as batch from
 (select type, id, rel, line, minutes, impact, round_even(impact::double / minutes, 2) as roi, sum(minutes) over w as running, row_number() over w as place from {ITEMS}
  window w as (order by round_even(impact::double / minutes, 2) desc, type, id, rel, line rows unbounded preceding)))"""


@query(f"select type, id, rel, line, minutes::int as minutes, impact::int as impact, roi, running::bigint as running, place::bigint as place, batch from {BATCHED}")
def action_items(spark, d):
    """Every finding and smell with its place, running minutes and batch."""
    return rollups.sprint_batches(_items(spark, d)).drop("severity")


@query(f"""with n as (select unnest(range(4)) as pos, unnest(['now', 'next', 'later', 'backlog']) as batch), b as (select batch, count(*) as items, sum(minutes) as minutes from {BATCHED} group by 1),
 j as (select pos, batch, coalesce(items, 0)::bigint as items, coalesce(minutes, 0)::bigint as minutes from n left join b using (batch))
 select batch, items, minutes, round_even(minutes / 60.0::double, 1) as hours, round_even(100.0::double * sum(items) over (order by pos) / greatest(sum(items) over (), 1), 0)::bigint as pct_resolved from j""")
def action_batches(spark, d):
    return rollups.batch_summary(rollups.sprint_batches(_items(spark, d)))


@query("select url, model from (select page_id::varchar as url, html as context from pages) join (select distinct lang || '-' || regexp_extract(text, '[A-Za-z]+') as m, regexp_extract(text, '[A-Za-z]+') as model from documents) on model <> '' and contains(context, model) group by 1, 2")
def endpoint_models(spark, d):
    """The first words of all documents as models, within whole pages as what follows an endpoint."""
    pages = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), F.col("html").alias("context"), F.lit("p").alias("rel"), F.lit(1).alias("line"))
    models = read(spark, d, "documents").select(F.regexp_extract("text", "[A-Za-z]+", 0).alias("model"))
    return interfaces.endpoint_models(pages, models)


@query("""with t as (select distinct trim(replace(lower(regexp_extract(p_name, '[a-zA-Z0-9]+')), '_', '-')) as package from part), d as (select distinct lower(regexp_extract(text, '[a-zA-Z0-9]+')) as p from documents)
 select package from t where package <> '' and not exists (select 1 from d where p <> '' and (contains(package, p) or contains(p, package)))""")
def missing_packages(spark, d):
    """First words of parts that neither hold a first word of a document nor lie within one."""
    word = lambda c: F.lower(F.regexp_extract(c, "[a-zA-Z0-9]+", 0))
    imports = read(spark, d, "part").select(word("p_name").alias("module"), F.lit(False).alias("relative"))
    declared = read(spark, d, "documents").select(word("text").alias("package"))
    return code.missing_packages(imports, declared, spark.createDataFrame([], "module string"), [])


PAD = "x" * 130


def _ui(spark, d):
    """A script for each nation with a call a customer; lines so far apart that none lies in another's context."""
    c = read(spark, d, "customer").withColumn("path", F.expr("concat('/api/n', c_nationkey, '/c', c_custkey % 7)"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("fetch('"), "path", F.lit("?q=1', {method: 'post'}) // " + PAD))).otherwise(F.concat(F.lit("api('"), "path", F.lit("') // " + PAD)))
    return c.select("c_nationkey", "c_custkey", text.alias("text")).groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))), lambda x: x["text"]), "\n").alias("content")).selectExpr("concat('ui/n', c_nationkey, '.js') as rel", "content")


def _server(spark, d):
    """A module for each nation with a handler a supplier, of two lines."""
    k = F.col("s_suppkey") % 3
    s = read(spark, d, "supplier").withColumn("path", F.expr("concat('/api/n', s_nationkey, '/c', s_suppkey % 9)"))
    head = F.when(k == 0, F.concat(F.lit("@app.route('"), "path", F.lit("/', methods=['PUT'])"))).when(k == 1, F.concat(F.lit("@app.get('"), "path", F.lit("')"))).otherwise(F.concat(F.lit("@app.route('"), "path", F.lit("')")))
    body = F.when(F.col("s_suppkey") % 11 == 0, "def f(): return request.json").otherwise("def f(): pass")
    text = F.concat(head, F.lit(" # " + PAD + "\n"), body, F.lit(" # " + PAD))
    return s.select("s_nationkey", "s_suppkey", text.alias("text")).groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "text"))), lambda x: x["text"]), "\n").alias("content")).selectExpr("concat('server/n', s_nationkey, '.py') as rel", "content")


@query("""with c as (select '/api/n' || c_nationkey || '/c' || c_custkey % 7 as url, 'ui/n' || c_nationkey || '.js' as rel, row_number() over (partition by c_nationkey order by c_custkey) as line, case when c_custkey % 2 = 0 then 'fetch' else 'api' end as kind, case when c_custkey % 2 = 0 then 'POST' else 'UNKNOWN' end as method from customer),
 h as (select '/api/n' || s_nationkey || '/c' || s_suppkey % 9 as route, s_suppkey % 3 as k, 'server/n' || s_nationkey || '.py' as rel, 2 * row_number() over w - 1 as line, bool_or(s_suppkey % 11 = 0) over (w rows between current row and 14 following) as receives_input from supplier window w as (partition by s_nationkey order by s_suppkey)),
 s as (select *, case when k = 0 then route || '/' else route end as url, case k when 0 then 'PUT' when 1 then 'GET' else 'ANY' end as method, unnest(case when k = 1 then ['fastapi', 'express'] else ['flask'] end) as kind from h),
 b as (select url as route, 'ui' as side, rel, line, kind, url, method, null::boolean as receives_input from c union all select route, 'backend', rel, line, kind, url, method, receives_input from s),
 n as (select route, count(*) filter (where side = 'ui') as u, count(*) filter (where side = 'backend') as v from b group by 1)
 select route, case when v = 0 then 'orphan_ui' when u = 0 then 'orphan_backend' else 'wired' end as status, case when u > 0 and v > 0 then case when u = 1 and v = 1 then '1:1' when u > 1 then 'many:1' else '1:many' end end as cardinality,
  side, rel, line::bigint as line, kind, url, method, receives_input from b join n using (route)""")
def connection_places(spark, d):
    """Calls and routes of generated scripts and modules, each with its place, method and what it is wired to."""
    files = tree.from_table(_ui(spark, d).unionByName(_server(spark, d)), "rel", "content")
    return connections.connected(connections.ui_calls(files), connections.server_routes(files))
