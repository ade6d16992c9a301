"""What the two sides of an interface agree on: fields of models and scripts, endpoints, tests, parameters, impact."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import route
from . import containment, relational

SCRIPTS = "ext in ('js', 'jsx', 'ts', 'tsx', 'vue', 'svelte')"
# Calls in scripts, fields read, taken apart and sent around them; declared endpoints; what tests mention.
CALL = r"""(?:fetch|axios\.\w+|api)\s*\(\s*[`'"](/[^'"`\s]+)[`'"]"""
READ = r"""(?:data|response|result|res|json|body|payload|item|row|record)(?:\.\s*(\w+)|\[\s*['"]([\w]+)['"]\s*\])"""
APART = r"""(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:data|response|result|res|await|props)"""
SENT = r"""['"]([\w]+)['"]\s*:"""
ENDPOINTS = (r"""@\w+\.\s*(route|get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", r"""(?:app|router)\.\s*(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""")
URL, USED, IMPORTED = r"""['"](/api/[^'"]+)['"]""", r"(\w+)\s*\(", r"from\s+\S+\s+import\s+(.+)"
PARAMETERS = (r"<(\w+)(?::\w+)?>", r":(\w+)", r"\{(\w+)\}")
RECEIVES = r"request\.(?:json|form|args|data|files|values|get_json|POST|GET|body|query_params)|req\.(?:body|params|query|file|files)|self\._read_body\(\)"


def surroundings(lines: DataFrame, before: int, after: int) -> DataFrame:
    """Adds context: the text from `before` lines above to `after` below. One sort a file; windows are bounded."""
    w = Window.partitionBy("rel").orderBy("line").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def script_fields(lines: DataFrame) -> DataFrame:
    """url, field, use (read or sent) around each call of a script; one-letter names don't count."""
    at = surroundings(lines, 5, 14).where(F.col("text").rlike(CALL)).select(F.regexp_extract("text", CALL, 1).alias("url"), "context")
    every = lambda p, g: F.regexp_extract_all("context", F.lit(p), F.lit(g))
    parts = F.flatten(F.transform(every(APART, 1), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.regexp_replace(y, r"\s*[:=].*$", "")))))
    read = F.concat(every(READ, 1), every(READ, 2), parts)
    rows = at.select("url", F.explode(F.concat(F.transform(read, lambda f: F.struct(f.alias("field"), F.lit("read").alias("use"))), F.transform(every(SENT, 1), lambda f: F.struct(f.alias("field"), F.lit("sent").alias("use"))))).alias("f"))
    return rows.select("url", "f.*").where("length(field) > 1").distinct()


def endpoint_models(routes: DataFrame, models: DataFrame) -> DataFrame:
    """url, model for endpoints whose next 30 lines name a model; the last place of a route counts."""
    place = F.struct("rel", "line", F.xxhash64("context").alias("x"), F.xxhash64(F.lit(7), "context").alias("y"))  # the hashes stand for the context
    spark = routes.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # files may be few
    dealt = routes.select("url", place.alias("place"), "context").repartition(parts, "url", "place")
    last = [t.groupBy("url").agg(F.max_by("model", "place").alias("model")) for t in containment.listed(dealt, "context", models, "model")]
    return functools.reduce(DataFrame.unionByName, [t.select("url", F.explode("model").alias("model")) for t in last])


def declared_endpoints(lines: DataFrame) -> DataFrame:
    """rel, line, method, url of all declarations, both patterns on every line; `route` is GET."""
    one = lambda p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, p, 1).alias("m"), F.regexp_extract(m, p, 2).alias("url")))
    rows = lines.select("rel", "line", F.explode(F.concat(*map(one, ENDPOINTS))).alias("e"))
    return rows.select("rel", "line", F.when(F.col("e.m") == "route", "GET").otherwise(F.upper("e.m")).alias("method"), F.col("e.url").alias("url"))


def endpoints_with_input(lines: DataFrame) -> DataFrame:
    """Declared endpoints with receives_input: whether the next 30 lines read the request."""
    near = surroundings(lines, 0, 29).select("rel", "line", F.col("context").rlike(RECEIVES).alias("receives_input"))
    return declared_endpoints(lines).join(near, ["rel", "line"])


def field_drift(fields: DataFrame, used: DataFrame, models: DataFrame) -> DataFrame:
    """Drift between model fields (model, field) and script fields (url, field), through url-model pairs."""
    seen = used.join(models, "url").select("model", "field").distinct()
    touched = fields.join(models.select("model").distinct(), "model", "left_semi")
    return relational.drift(touched, seen)


def test_uses(lines: DataFrame) -> DataFrame:
    """Names that test files mention: urls, called and imported names."""
    t = lines.where(F.col("rel").rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$|\.(test|spec)\.[jt]sx?$"))
    names = F.concat(F.regexp_extract_all("text", F.lit(URL), F.lit(1)), F.regexp_extract_all("text", F.lit(USED), F.lit(1)), F.transform(F.split(F.regexp_extract("text", IMPORTED, 1), ","), lambda x: F.trim(x)))
    return t.select(F.explode(names).alias("name")).where("name != ''").distinct()


def parameter_mismatches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Route keys whose first call and first route name different parameters."""
    params = lambda c: F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in PARAMETERS])))
    first = lambda df, n: df.where(F.size(params(F.col("url"))) > 0).groupBy("key").agg(F.min_by(params(F.col("url")), F.struct("rel", "url")).alias(n))
    return first(calls, "front").join(first(routes, "back"), "key").where("front != back")


def impact(risk: DataFrame, edges: DataFrame, seeds: int = 8, hops: int = 2) -> DataFrame:
    """node, level, impact = risk + degree * (2.5 - level) around the riskiest nodes."""
    start = risk.orderBy(F.desc("score"), "node").limit(seeds).select("node")
    reached = relational.within_hops(edges, start, "node", hops)
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    df = reached.join(degree, "node", "left").join(risk, "node", "left").na.fill(0, ["degree", "score"])
    return df.select("node", "level", F.bround(F.col("score") + F.col("degree") * (2.5 - F.col("level")), 2).alias("impact"))


def code_slice(lines: DataFrame, functions: DataFrame, targets: DataFrame, around: int = 10) -> DataFrame:
    """rel, line, slice: the tightest function around a target if it is short, else `around` lines each way; the target is marked."""
    t = targets.select("rel", F.col("line").alias("at"))
    f = functions.select(F.col("rel").alias("r"), F.col("line").alias("a"), F.col("end_line").alias("z"))
    scope = t.join(f, (F.col("rel") == F.col("r")) & F.col("at").between(F.col("a"), F.col("z")), "left").groupBy("rel", "at").agg(F.min_by(F.struct("a", "z"), F.col("z") - F.col("a")).alias("s"))
    short = F.col("s.z") - F.col("s.a") + 1 <= 2 * around
    scope = scope.select("rel", "at", F.when(short, F.col("s.a")).otherwise(F.col("at") - around).alias("lo"), F.when(short, F.col("s.z")).otherwise(F.col("at") + around).alias("hi"))
    rows = scope.join(lines, "rel").where(F.col("line").between(F.col("lo"), F.col("hi")))
    mark = F.when(F.col("line") == F.col("at"), F.lit(">> ")).otherwise(F.lit("   "))
    got = rows.groupBy("rel", "at").agg(F.array_sort(F.collect_list(F.struct("line", F.concat(mark, "text").alias("t")))).alias("ls"))
    return got.select("rel", F.col("at").alias("line"), F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("slice"))


def by_extension(files: DataFrame) -> DataFrame:
    return files.where("ext in ('py', 'js', 'ts', 'jsx', 'tsx', 'html', 'css', 'rs')").groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def same_route(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of urls with one normal form."""
    x, y = a.select("url", route(F.col("url")).alias("k")).distinct(), b.select(F.col("url").alias("other"), route(F.col("url")).alias("k")).distinct()
    return x.join(y, "k").select("url", "other")
