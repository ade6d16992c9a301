"""Rule matching as a Catalyst expression: every match with its offset, line and column, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, matched_text, start (0-based), line, col for every non-overlapping match of a pattern that consumes characters.

    The pieces between matches and the matches themselves alternate, so a match starts where the
    lengths of all before it add up to. Only texts that match at all are cut up.
    """
    found = df.where(F.col(text).rlike(pattern)).select(key, F.col(text).alias("__text"))
    found = found.withColumns({"__between": F.split("__text", pattern, -1), "__found": F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))})
    lengths = F.zip_with("__between", "__found", lambda b, m: F.struct(F.length(b).alias("b"), F.length(F.coalesce(m, F.lit(""))).alias("m")))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["end"] + x["b"] + x["m"]).alias("end"), F.concat(acc["starts"], F.array(acc["end"] + x["b"])).alias("starts")))["starts"]
    rows = found.withColumn("__starts", starts).select(key, "__text", "__starts", F.posexplode("__found").alias("__i", "matched_text"))
    rows = rows.withColumn("start", F.get("__starts", F.col("__i"))).drop("__starts")
    return rows.select(key, "matched_text", F.col("start").cast("long").alias("start"), *position(F.substring("__text", F.lit(1), F.col("start"))))


def position(before: Column) -> list[Column]:
    """1-based line and column of what follows `before`."""
    line = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line")
    return [line, (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long").alias("col")]


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (1-based), text of each line; breaks are \\n after \\r\\n and \\r were made \\n."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    rows = df.select(key, F.posexplode(cut).alias("p", "__line"))
    return rows.select(key, (F.col("p") + 1).cast("long").alias("line"), F.col("__line").alias("text"))
