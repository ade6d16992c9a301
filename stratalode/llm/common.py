"""Scratch tables, table access and text expressions that the corpus operators share."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters outside ASCII that lower() would change.
WIDE_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
#: What separates words: white space, or whatever is neither a-z, 0-9 nor outside ASCII.
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of an Arrow batch on its way to a Python worker at most.
BATCH_BYTES = 4 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which every executor shares; a temporary folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stratalode-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _drop() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            return


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df as written to the shared folder and read back: cuts lineage, survives lost executors, and gives the planner sizes."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands Python workers batches of BATCH_BYTES or less from now on, unless it asks for smaller ones.

    The batch that is built in the JVM, its buffers that double and its copy in the worker all count to an executor's memory; by
    default they hold up to 64 MB each, whatever the length of the rows.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)))
    if not 0 < now <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. lower() is much the faster way where it can change no other letter."""
    return F.when(text.rlike(WIDE_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(text, separators), "")


def broadcast_within(df: DataFrame, rows: int, most: int = 2_000_000) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its counted rows are within the bound, and whether they are."""
    return (F.broadcast(df), True) if rows <= most else (df, False)


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of the bytes of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(df: DataFrame) -> int:
    """The bytes of df: of files those that the planner has read from them, of any other plan, where its estimates may be off by any factor, those of the texts, counted."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if all(re.match(r"[ :+|-]*(Project|Filter|Relation)\b", line) for line in plan.strip().split("\n")):
        return plan_bytes(df)
    return df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0


def parts_for(df: DataFrame, each: int, few: int) -> int:
    """How many parts to deal df to, by its bytes: one for every `each`, but of few bytes as many as there are shuffle partitions, up to `few`."""
    return max(-(-text_bytes(df) // each), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), few), 1)


def by_part(df: DataFrame, n: int) -> GroupedData:
    """df dealt by `part`, one of even_keys(n), each to a partition of its own."""
    return df.repartition(n, "part").groupBy("part")


def repeatable(df: DataFrame) -> DataFrame:
    """df if a task that runs again gets its rows in the same order, as from files; otherwise written first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    again = not any(x in plan for x in ("Join", "Aggregate", "Repartition", "Rebalance", "Sort", "Window", "Limit", "Sample"))
    return df if again else stored(df, "rows")


@functools.cache
def even_keys(n: int) -> np.ndarray:
    """n integers, the i-th of which Spark's hash partitioning into n puts into partition i, so that no partition gets two parts and none gets no part."""
    out, have, at = np.full(n, -1, np.int64), 0, 0
    rotate = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    while have < n:
        x = np.arange(at, at + 16 * n, dtype=np.uint32)
        h = rotate(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)  # Murmur3 of one int, seed 42
        h = rotate(h ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
        where, first = np.unique((h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n, return_index=True)
        new = out[where] < 0
        out[where[new]] = x[first[new]]
        have += int(new.sum())
        at += 16 * n
    return out


def even_key(part: Column, n: int) -> Column:
    """even_keys(n) of a column of parts."""
    return F.get(F.from_json(F.lit(str(even_keys(n).tolist())), "array<int>"), part)


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row as many times as its column `times` says, and without that column. Two steps, so that no array gets longer than the root of the count."""
    step = F.ceil(F.sqrt(F.col(times))).cast("int")
    df = df.withColumn("__of", F.explode(F.sequence(F.lit(0), F.ceil(F.col(times) / step).cast("int") - 1)))
    rest = F.least(step.cast("long"), F.col(times) - F.col("__of") * step).cast("int")
    return df.withColumn("__in", F.explode(F.sequence(F.lit(1), rest))).drop("__of", "__in", times)
