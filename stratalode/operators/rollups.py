"""Scores, grades, plans and summaries over findings and other signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cut_to, grade
from . import ordered


def by_severity(severity: Column, high: object, medium: object, low: object, other: object) -> Column:
    return F.when(severity == "HIGH", high).when(severity == "MEDIUM", medium).when(severity == "LOW", low).otherwise(other)


def severity_counts(findings: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(F.count(F.lit(1)).alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"))


def summary_line(counts: DataFrame) -> DataFrame:
    return counts.select(F.format_string("%d findings: %d high, %d medium, %d low", "total", "high", "medium", "low").alias("summary"))


def quality_score(counts: DataFrame, files: Column) -> DataFrame:
    """100 - 25 high - 8 medium - 2 low - trunc(8 total / files), between 0 and 100."""
    raw = 100 - 25 * F.col("high") - 8 * F.col("medium") - 2 * F.col("low") - (8.0 * F.col("total") / F.greatest(files, F.lit(1))).cast("long")
    return counts.withColumn("score", cut_to(raw, 0, 100).cast("long"))


def gate(scored: DataFrame, most_high: int = 0, most_medium: int = 25, least_score: int = 70) -> DataFrame:
    """Adds passed, and failures as a joined list."""
    tests = [(F.col("high") > most_high, "high"), (F.col("medium") > most_medium, "medium"), (F.col("score") < least_score, "score")]
    out = scored.withColumn("failures", F.concat_ws(",", *[F.when(t, F.lit(n)) for t, n in tests]))
    return out.withColumn("passed", F.col("failures") == "")


def heatmap(signals: DataFrame, key: str) -> DataFrame:
    """Risk of each key from long signals (key, kind, weight): 5 security + 2 quality + 2 smells + 3 churn + duplicates; bands by share of the top."""
    kinds = ("security", "quality", "smells", "churn", "duplicates")
    df = signals.groupBy(key).agg(*[F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(k) for k in kinds])
    df = df.withColumn("score", F.bround(5 * F.col("security") + 2 * F.col("quality") + 2 * F.col("smells") + 3 * F.col("churn") + F.col("duplicates"), 1))
    top = df.agg(F.max("score").alias("__top"))
    share = F.col("score") / F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)
    return df.crossJoin(F.broadcast(top)).withColumn("band", F.when(share > 0.6, "high").when(share > 0.2, "medium").otherwise("low")).drop("__top")


def finding_signals(findings: DataFrame, key: str) -> DataFrame:
    """Security and other findings as signals, weighed 5, 2 or 0.5 by severity; 1 for an unknown one."""
    kind = F.when(F.col("rule_id").contains("SEC-"), "security").otherwise("quality")
    return findings.select(key, kind.alias("kind"), by_severity(F.col("severity"), 5.0, 2.0, 0.5, 1.0).alias("weight"))


def module_cards(findings: DataFrame, unit: str, item: str) -> DataFrame:
    """Grade and score of each unit from its weighted findings per 100 items."""
    df = findings.groupBy(unit).agg(F.countDistinct(item).alias("items"), F.sum(by_severity(F.col("severity"), 5.0, 2.0, 0.5, 1.0)).alias("weighted"))
    df = df.withColumn("per_100", F.col("weighted") / F.col("items") * 100)
    letter = grade(F.col("per_100"), (5, "A"), (15, "B"), (40, "C"), (80, "D"), below="F", ascending=True)
    x = F.col("per_100")
    value = F.when(x <= 5, 100 - x).when(x <= 15, 100 - x * 0.8).when(x <= 40, 100 - x * 0.6).when(x <= 80, F.greatest(F.lit(20.0), 100 - x * 0.5)).otherwise(F.greatest(F.lit(5.0), 100 - x * 0.4))
    return df.withColumn("grade", letter).withColumn("score", F.greatest(value, F.lit(0.0)).cast("long"))


def review(findings: DataFrame, smells: Column | None = None, dead: Column | None = None) -> DataFrame:
    """Score, letter, blockers, decision and minutes to fix, in one row."""
    sec = F.col("rule_id").contains("SEC-")
    c = findings.agg(
        F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("severity") == "MEDIUM").alias("medium"), F.count_if(F.col("severity") == "LOW").alias("low"),
        F.count_if(sec).alias("security"), F.sum(by_severity(F.col("severity"), 15, 10, 5, 5)).alias("minutes"),
    )
    score = cut_to(F.bround(100 - 5 * F.col("high") - 2 * F.col("medium") - 0.5 * F.col("low"), 0), 0, 100).cast("long")
    c = c.withColumn("score", score).withColumn("blockers", F.col("high") + F.col("security"))
    c = c.withColumn("grade", grade(F.col("score"), (90, "A"), (75, "B"), (60, "C"), (40, "D"), below="F"))
    c = c.withColumn("decision", F.when((F.col("blockers") == 0) & (F.col("score") >= 60), "GO").otherwise("NO-GO"))
    extra = F.lit(0) + (15 * smells if smells is not None else 0) + (5 * dead if dead is not None else 0)
    return c.withColumn("minutes", (F.coalesce("minutes", F.lit(0)) + extra).cast("long"))


def action_items(findings: DataFrame, smells: DataFrame | None = None) -> DataFrame:
    """type, id, rel, line, severity, minutes, impact, roi of everything there is to do: findings (rule_id) and smells (smell)."""
    f = findings.select(F.lit("finding").alias("type"), F.col("rule_id").alias("id"), "rel", "line", "severity", rule_minutes(F.col("rule_id")).alias("minutes"), by_severity(F.col("severity"), 10, 4, 1, 2).alias("impact"))
    if smells is not None:
        f = f.unionByName(smells.select(F.lit("smell").alias("type"), F.col("smell").alias("id"), "rel", "line", "severity", F.lit(15).alias("minutes"), by_severity(F.col("severity"), 8, 3, 1, 2).alias("impact")))
    return f.withColumn("roi", F.bround(F.col("impact") / F.col("minutes"), 2))


def rule_minutes(rule_id: Column) -> Column:
    return F.when(rule_id.startswith("SEC-"), 15).when(rule_id.startswith("QUAL-"), 5).otherwise(10)


def sprint_batches(items: DataFrame, order: tuple[str, ...] = ("-roi", "type", "id", "rel", "line")) -> DataFrame:
    """Items with the running minutes down to each, best return first, their place in that order and the batch that these fall in."""
    df = ordered.running(items, list(order), "minutes", "running", "place").withColumn("running", F.col("running").cast("long"))
    batch = F.when(F.col("running") <= 240, "now").when(F.col("running") <= 480, "next").when(F.col("running") <= 960, "later").otherwise("backlog")
    return df.withColumn("batch", batch)


def batch_summary(batched: DataFrame) -> DataFrame:
    """batch, items, minutes, hours and the share of all items resolved once it is done; a row for each of the four."""
    of = batched.groupBy("batch").agg(F.count("*").alias("items"), F.sum("minutes").cast("long").alias("minutes"))
    names = batched.sparkSession.createDataFrame([(0, "now"), (1, "next"), (2, "later"), (3, "backlog")], "at int, batch string")
    df = names.join(of, "batch", "left").select("at", "batch", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("minutes", F.lit(0)).alias("minutes"))
    done, all_ = F.sum("items").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)), F.sum("items").over(Window.partitionBy())  # four rows
    return df.select("batch", "items", "minutes", F.bround(F.col("minutes") / 60.0, 1).alias("hours"), F.bround(100.0 * done / F.greatest(all_, F.lit(1)), 0).cast("long").alias("pct_resolved"))


def batch_totals(tasks: DataFrame) -> DataFrame:
    """The same batches without ordering rows: tasks of one roi are alike, so each class is cut by arithmetic.

    Rows of one severity have the same minutes and roi; batch sizes follow from the counts, one row a severity, so no task
    sorts all rows.
    """
    df = tasks.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    df = df.withColumn("minutes", by_severity(F.col("severity"), 15, 5, 10, 10)).withColumn("impact", by_severity(F.col("severity"), 10, 4, 1, 2))
    df = df.withColumn("roi", F.bround(F.col("impact") / F.col("minutes"), 2))
    w = Window.orderBy(F.desc("roi"), "severity").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("minutes")).over(w), F.lit(0)))
    fit = lambda top: F.least(F.greatest(F.floor((top - F.col("before")) / F.col("minutes")), F.lit(0)), F.col("n"))
    a, b, c = fit(240), fit(480), fit(960)
    named = lambda name, n: F.struct(F.lit(name).alias("batch"), n.alias("tasks"))
    parts = F.array(named("now", a), named("next", b - a), named("later", c - b), named("backlog", F.col("n") - c))
    rows = df.select("minutes", F.explode(parts).alias("p"))
    return rows.groupBy("p.batch").agg(F.sum("p.tasks").cast("long").alias("tasks"), F.sum(F.col("p.tasks") * F.col("minutes")).cast("long").alias("minutes"))


def feedback(votes: DataFrame, by: str, useful: Column, least: int = 3, share: float = 0.7) -> DataFrame:
    """Noisy and useful ratios of each group with enough votes, and what to do about it."""
    df = votes.groupBy(by).agg(F.count(F.lit(1)).alias("votes"), F.count_if(useful).alias("useful")).where(F.col("votes") >= least)
    df = df.withColumn("useful_ratio", F.bround(F.col("useful") / F.col("votes"), 2)).withColumn("noisy_ratio", F.bround((F.col("votes") - F.col("useful")) / F.col("votes"), 2))
    return df.withColumn("advice", F.when(F.col("noisy_ratio") >= share, "suppress").when(F.col("useful_ratio") >= share, "keep").otherwise("review"))


def calibrate(rows: DataFrame, false_rate: Column, ast: Column, context: Column, taint: Column, test: Column, string: Column, history: Column) -> DataFrame:
    """Adds confidence: a base of 1 - false_rate, scaled by each sign, blended with 30 % of history, from 0.05 to 0.99."""
    c = 1 - F.coalesce(false_rate, F.lit(0.15))
    c = c * F.when(ast, 1.15).otherwise(1.0) * F.when(context, 1.10).otherwise(1.0)
    c = c * F.when(taint.isNull(), 1.0).when(taint, 1.20).otherwise(0.60) * F.when(test, 0.70).otherwise(1.0) * F.when(string, 0.40).otherwise(1.0)
    c = F.when(history.isNotNull(), 0.7 * c + 0.3 * history).otherwise(c)
    return rows.withColumn("confidence", F.bround(cut_to(c, 0.05, 0.99), 4))


def remediation(findings: DataFrame) -> DataFrame:
    """Minutes and hours to fix: security 15, quality 5, others 10 each."""
    return findings.agg(F.sum(rule_minutes(F.col("rule_id"))).alias("minutes")).select(F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"), F.bround(F.coalesce("minutes", F.lit(0)) / 60.0, 1).alias("hours"))


def plan(findings: DataFrame, most: int | None = None) -> DataFrame:
    """The order to fix in: severity, confidence, safe fixes first, rule, file, line; the first `most`, or all with their place in it."""
    keys = {"__severity": by_severity(F.col("severity"), 0, 1, 2, 9), "__tier": F.when(F.col("tier") == "safe", 0).otherwise(1)}
    order, df = ["__severity", "-confidence", "__tier", "rule_id", "rel", "line"], findings.withColumns(keys)
    if most is None:
        return ordered.running(df.withColumn("__one", F.lit(1)), order, "__one", "__total", "place").drop("__one", "__total", *keys)
    return df.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]).limit(most).drop(*keys)


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, truncated; 100 of nothing."""
    return F.when(whole == 0, 100).otherwise((100.0 * part / whole).cast("long")).cast("long")


def checks_score(checks: DataFrame) -> DataFrame:
    """Score of weighted checks (name, weight, passed): rounded percentage and its band."""
    df = checks.agg(F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0)).alias("got"), F.sum("weight").alias("most"))
    df = df.select(F.bround(100.0 * F.col("got") / F.col("most"), 0).cast("long").alias("score"))
    return df.withColumn("band", grade(F.col("score"), (80, "high"), (60, "good"), (40, "fair"), below="low"))


def true_rate(votes: DataFrame, by: str, verdict: Column, least: int = 3) -> DataFrame:
    """Share of true verdicts of each group; null under `least` votes."""
    return votes.groupBy(by).agg(F.count(F.lit(1)).alias("votes"), F.avg(verdict.cast("int")).alias("__r")).select(by, "votes", F.when(F.col("votes") >= least, F.col("__r")).alias("true_rate"))


def suggested_rules(advice: DataFrame, by: str, most: int = 10) -> DataFrame:
    """One row a kind of advice: the first groups by votes as a YAML list."""
    from pyspark.sql.window import Window as W

    ranked = advice.withColumn("__k", F.row_number().over(W.partitionBy("advice").orderBy(F.desc("votes"), by))).where(F.col("__k") <= most)
    rows = ranked.groupBy("advice").agg(F.array_sort(F.collect_list(F.struct("__k", F.concat(F.lit("  - "), F.col(by)).alias("l")))).alias("ls"))
    return rows.select("advice", F.concat(F.col("advice"), F.lit(":\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("yaml"))


def fix_statistics(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("method").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verified")).alias("verified"))
