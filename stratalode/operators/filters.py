"""Predicates on findings: test paths, policy, severity, excludes, confidence and inline suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import outside_intervals, range_marks
from .rules import DROPPED_BALANCED, DROPPED_RELAXED

SEVERITIES = ("HIGH", "MEDIUM", "LOW")
#: A suppression comment of any tool name: kind and rule ids.
COMMENT = r"#\s*[\w-]+:\s*(ignore|ignore-next|ignore-file|ignore-start|ignore-end)\[([^\]]+)\]"
END = (1 << 31) - 1


def is_test(rel: Column) -> Column:
    name = F.regexp_extract(rel, r"([^/]*)$", 1)
    return F.concat(F.lit("/"), rel).contains("/tests/") | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def policy(findings: DataFrame, profile: str = "balanced", include_tests: bool = False) -> DataFrame:
    """strict keeps all; balanced and relaxed-tests drop their rules on test paths, unless tests are included."""
    if profile == "strict" or include_tests:
        return findings
    dropped = DROPPED_RELAXED if profile == "relaxed-tests" else DROPPED_BALANCED
    return findings.where(~(is_test(F.col("rel")) & F.col("rule_id").isin(*dropped)))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(severity) + 1]))


def excluded(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files whose path matches none of the patterns; a pattern that doesn't compile is left out."""
    import re

    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        files = files.where(~F.col("rel").rlike(p))
    return files


def since(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("rel").distinct(), "rel", "left_semi")


def confident(findings: DataFrame, least: float = 0.3) -> DataFrame:
    return findings.where(F.col("confidence") >= least)


def suppressions(lines: DataFrame) -> DataFrame:
    """rel, rule_id, first, last: the spans that comments suppress. Ranges nest by rule, a stray end counts for nothing, an open range runs on; ignore-next on the last line is dropped."""
    from pyspark.sql.window import Window

    got = lines.where(F.col("text").rlike(COMMENT)).select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(COMMENT), F.lit(0))).alias("m"))
    ids = F.explode(F.filter(F.transform(F.split(F.regexp_extract("m", COMMENT, 2), ","), lambda x: F.trim(x)), lambda x: x != ""))
    got = got.select("rel", "line", F.regexp_extract("m", COMMENT, 1).alias("kind"), ids.alias("rule_id"))
    last = lines.groupBy("rel").agg(F.max("line").alias("__last"))
    here = got.where("kind = 'ignore'").select("rel", "rule_id", F.col("line").alias("first"), F.col("line").alias("last"))
    nxt = got.where("kind = 'ignore-next'").join(last, "rel").where(F.col("line") < F.col("__last")).select("rel", "rule_id", (F.col("line") + 1).alias("first"), (F.col("line") + 1).alias("last"))
    whole = got.where("kind = 'ignore-file'").select("rel", "rule_id", F.lit(0).cast("long").alias("first"), F.lit(END).cast("long").alias("last"))
    m = got.where("kind in ('ignore-start', 'ignore-end')").withColumn("opens", F.col("kind") == "ignore-start")
    w = Window.partitionBy("rel", "rule_id").orderBy("line")
    level = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(w)
    m = m.withColumn("level", level).withColumn("low", F.least(F.min("level").over(w), F.lit(0)))
    m = m.withColumn("stray", ~F.col("opens") & (F.col("low") < F.lag("low", 1, 0).over(w))).where("not stray")
    spans = range_marks(m, ["rel", "rule_id"], "line", F.col("opens"), F.lit(END).cast("long"))
    return here.unionByName(nxt).unionByName(whole).unionByName(spans.select("rel", "rule_id", F.col("first").cast("long"), F.col("last").cast("long")))


def unsuppressed(findings: DataFrame, spans: DataFrame) -> DataFrame:
    return outside_intervals(findings, spans, ["rel", "rule_id"], "line", "first", "last")
