"""Reports and summaries: JSON report and exit code, model verdicts, fix history, feedback, contracts and counts of elements."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import grade
from . import containment
from .rollups import by_severity

# How a declared component shows in code; group 1 is its name.
COMPONENT = [r"(?:function|const|class)\s+([\w$]+)", r"<([^\s/>]+)[\s/>]", r"""id\s*=\s*['"]([^'"]+)['"]"""]
COMPONENT_EXT = ("js", "jsx", "ts", "tsx", "html", "vue", "svelte")
# Lines that open functions and classes, or import.
ELEMENTS = {"functions": r"^\s*(?:async\s+)?def\s+\w+", "classes": r"^\s*class\s+\w+", "imports": r"^\s*(?:import|from)\s+"}
WEIGHTS = {"easy": 1.0, "medium": 1.5, "hard": 2.0}
FEEDBACK = "array<struct<rule_id:string,file:string,line:bigint,verdict:string,useful:boolean,note:string>>"


def json_report(findings: DataFrame, files: int, rules: int, gate: DataFrame | None = None, most_text: int = 200) -> str:
    """A whole JSON report on the driver, for what fits there; matched texts are cut to most_text characters."""
    from .rollups import severity_counts

    counts = severity_counts(findings).first().asDict()
    rows = findings.withColumn("matched_text", F.left("matched_text", F.lit(most_text))) if "matched_text" in findings.columns else findings
    out = {"files_scanned": files, "rules_checked": rules, "findings": [r.asDict(True) for r in rows.orderBy("rel", "line", "rule_id").toLocalIterator()], "summary": counts}
    if gate is not None:
        out["quality_gate"] = gate.first().asDict(True)
    return json.dumps(out, indent=2)


def exit_code(gate: DataFrame | None) -> int:
    """2 for a failed gate, otherwise 0."""
    return 2 if gate is not None and not gate.first().passed else 0


def by_type(smells: DataFrame, kind: str) -> DataFrame:
    return smells.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def first_by_severity(smells: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """Counts by severity of the first `most` smells, which is what a report shows."""
    return smells.orderBy(*order).limit(most).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def advisory_summary(advisories: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return advisories.agg(F.count(F.lit(1)).alias("total"), *[n(s.upper()).alias(s) for s in ("critical", "high", "medium", "low")])


def split_suppressed(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that count, and those that a model called false."""
    off = F.coalesce(F.col("llm_suppressed"), F.lit(False))
    return findings.where(~off), findings.where(off)


def pipeline_summary(findings: DataFrame) -> DataFrame:
    """Totals, and counts by severity of the findings that are not suppressed."""
    on = ~F.coalesce(F.col("llm_suppressed"), F.lit(False))
    n = lambda s: F.count_if(on & (F.col("severity") == s))
    return findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(on).alias("active"), F.count_if(~on).alias("suppressed"), *[n(s.upper()).alias(s) for s in ("critical", "high", "medium", "low")]
    )


def overall_grade(findings: DataFrame, files: Column) -> DataFrame:
    """Letter of 100 less 10, 3 or 1 a finding, over ten times the files."""
    scanned = F.greatest(files, F.lit(1))
    df = findings.agg(F.coalesce(F.sum(by_severity(F.col("severity"), 10, 3, 1, 1)), F.lit(0)).alias("penalty"))
    score = F.greatest(100 - F.floor(F.col("penalty") * 100 / (scanned * 10)), F.lit(0)).cast("long")
    return df.select(F.col("penalty").cast("long").alias("penalty"), score.alias("score")).withColumn("grade", grade(F.col("score"), (90, "A"), (70, "B"), (50, "C"), (30, "D"), below="F"))


def elements(lines: DataFrame, key: str) -> DataFrame:
    """Lines, functions, classes and imports of each file, from its lines (key, line, text)."""
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in ELEMENTS.items()])


def largest(counted: DataFrame, key: str, most: int = 20) -> DataFrame:
    return counted.orderBy(F.desc("lines"), key).limit(most)


def god_modules(edges: DataFrame, least: int = 5, most: int | None = 10) -> DataFrame:
    """Modules that `least` or more imports lead to, the most wanted first."""
    df = edges.groupBy(F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("dependents")).where(F.col("dependents") >= least)
    return df.orderBy(F.desc("dependents"), "module").limit(most) if most else df


def coupling_health(degrees: DataFrame) -> DataFrame:
    """Adds cohesion and health to ca, ce, instability, n_functions, n_lines."""
    ca, ce = F.col("ca"), F.col("ce")
    cohesion = F.when((ce <= 2) & (F.col("n_functions") <= 8), "high").when(ce <= 5, "medium").otherwise("low")
    health = F.when((ca >= 5) & (ce >= 5), "god_module").when((F.col("instability") > 0.8) & (ca >= 3), "fragile")
    health = health.when((ca == 0) & (ce == 0) & (F.col("n_lines") > 20), "isolated").when(ce > 8, "dependent").otherwise("healthy")
    return degrees.withColumns({"cohesion": cohesion, "health": health})


def coupling_summary(healthy: DataFrame) -> DataFrame:
    names = ("healthy", "god_module", "fragile", "isolated", "dependent")
    counts = [F.count_if(F.col("health") == n).alias(n) for n in names]
    return healthy.agg(F.count(F.lit(1)).alias("modules"), F.bround(F.avg("instability"), 2).alias("avg_instability"), *counts)


def has_test(functions: DataFrame, test_files: DataFrame) -> DataFrame:
    """Adds has_test: whether the function's name is part of a test file's path."""
    found = containment.held(test_files, "rel", functions, "name", longest=8).select(F.col("name").alias("__n"))
    return functions.join(found, F.col("name") == F.col("__n"), "left").withColumn("has_test", F.col("__n").isNotNull()).drop("__n")


def stub_coverage(functions: DataFrame) -> DataFrame:
    df = functions.agg(F.count(F.lit(1)).alias("total"), F.count_if("has_test").alias("tested"))
    return df.select("total", "tested", (F.col("total") - F.col("tested")).alias("untested"), F.bround(100.0 * F.col("tested") / F.greatest("total", F.lit(1)), 1).alias("coverage_pct"))


def contract_components(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Declared components (name) with the first place (rel, line) that has them; a missing one is MEDIUM.

    Names are cut out of the lines and joined, so no line meets every component."""
    names = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in COMPONENT]))
    seen = lines.select(F.explode(F.array_distinct(names)).alias("__n"), F.struct("rel", "line").alias("at")).groupBy("__n").agg(F.min("at").alias("at"))
    df = wanted.join(seen, F.col("name") == F.col("__n"), "left")
    return df.select(*wanted.columns, "at.rel", "at.line", F.when(F.col("at").isNull(), "MEDIUM").alias("severity"))


def fingerprint_key(rule: Column, context_hash: Column, scope: Column, occurrence: Column) -> Column:
    return F.concat_ws(":", rule, F.left(context_hash, F.lit(12)), scope, occurrence.cast("string"))


def previously_fixed(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """Findings whose key is that of a recorded fix."""
    return findings.join(fixes.select("key").distinct(), "key", "left_semi")


def regressions(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """Findings with the record of the fix of the same key: the latest, if there are several. Findings without a key, for want of content, are left out."""
    last = fixes.groupBy("key").agg(F.max(F.struct("fixed_at", "fix")).alias("f"))
    return findings.join(last, "key").select(*findings.columns, "f.fixed_at", "f.fix")


def feedback_stats(votes: DataFrame, rule: str, verdict: Column) -> DataFrame:
    df = votes.agg(F.count(F.lit(1)).alias("total"), F.count_if(verdict).alias("true_positives"), F.countDistinct(rule).alias("rules"))
    return df.select("total", "true_positives", (F.col("total") - F.col("true_positives")).alias("false_positives"), "rules")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Entries of feedback files; a file that is no JSON, or has no list of entries, has none."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"struct<entries:{FEEDBACK}>", {"mode": "PERMISSIVE"})["entries"]).alias("e")).select("e.*")


def parse_verdict(response: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a model's answer: those of its last lines that say so; empty if none does."""
    lines = F.transform(F.split(response, r"\r\n|\n|\r"), lambda x: F.trim(x))
    said = F.transform(F.filter(lines, lambda x: F.upper(x).startswith("VERDICT:")), lambda x: F.upper(F.regexp_replace(x, "^[^:]*:", "")))
    known = F.transform(said, lambda x: F.when(x.rlike("FALSE[_ ]POSITIVE"), "FALSE_POSITIVE").when(x.rlike("TRUE[_ ]POSITIVE"), "TRUE_POSITIVE"))
    known = F.filter(known, lambda x: x.isNotNull())
    why = F.transform(F.filter(lines, lambda x: F.upper(x).startswith("REASON:")), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    return last(known), last(why)


def json_of(response: Column) -> Column:
    """The JSON text in a model's answer: what a fence holds, else all of it; null if it does not parse."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    text = F.when(response.rlike(r"(?s)```(?:json)?\s*\n?.*?```"), fenced).otherwise(response)
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.try_parse_json(text).isNotNull(), text)


def merge_specs(specs: DataFrame, key: str) -> DataFrame:
    """Sources, sinks and sanitizers of each key's specifications, sorted and distinct."""
    return specs.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("sources", "sinks", "sanitizers")])


def model_batches(findings: DataFrame, order: list[str], size: int = 10, most: int | None = 50, severities: tuple[str, ...] = ("HIGH", "CRITICAL")) -> DataFrame:
    """Adds batch, for the findings that a model is asked about: in order of rules, `size` to a call, `most` calls.

    Places come from counts a rule and places within it, so no task orders all findings."""
    some = findings.where(F.upper("severity").isin(*severities))
    inside = F.row_number().over(Window.partitionBy("rule_id").orderBy(*order)) - 1
    counts = some.groupBy("rule_id").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("rule_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a rule
    df = some.withColumn("__i", inside).join(counts.select("rule_id", before.alias("__b")), "rule_id")
    df = df.withColumn("batch", F.floor((F.col("__b") + F.col("__i")) / size).cast("long")).drop("__i", "__b")
    return df.where(F.col("batch") < most) if most else df


def compare_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of two engines by rule, and whether they agree."""
    n = lambda df, to: df.groupBy("rule_id").agg(F.count(F.lit(1)).alias(to))
    df = n(left, "left").join(n(right, "right"), "rule_id", "full").select("rule_id", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))
    return df.withColumn("agree", F.col("left") == F.col("right"))


def answer_score(accurate: Column, code_only: Column, concise: Column, anti: Column, difficulty: Column) -> Column:
    """Score of a model's answer: 60 for right ones, 20 for code alone, 10 for short and 10 for clean ones, times the difficulty's weight."""
    weight = F.coalesce(*[F.when(difficulty == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(1.0))
    return weight * (F.when(accurate & ~anti, 60).otherwise(0) + F.when(code_only, 20).otherwise(0) + F.when(concise, 10).otherwise(0) + F.when(anti, 0).otherwise(10))


def audit_text(audits: DataFrame) -> DataFrame:
    """One line a project: its name and counts by severity."""
    return audits.select("project", F.format_string("%s: %d high, %d medium, %d low", "project", "high", "medium", "low").alias("report"))


def head_md5(content: Column) -> Column:
    """md5 of the first 64 KiB, as change detection takes it."""
    return F.md5(F.substring(F.encode(content, "utf-8"), 1, 65536))
