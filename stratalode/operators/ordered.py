"""Running sums and ranks over a whole ordered table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

ROWS = 500_000


def running(df: DataFrame, order: list[str], value: str, total: str, place: str | None = None, parts: int | None = None) -> DataFrame:
    """df with `total`, the sum of `value` down to each row, and its number from 1 in `place` if asked for.

    order: columns, the largest value first where a minus stands before the name. Null values add nothing; rows that tie in all
    columns fall in any order, but always the same one within a result.

    Rows are dealt in ranges and written with their range. The sums of the ranges, one row each, give the offsets, and each
    range sums up its own rows. A number of each row is the last key, so that rows that tie are dealt to several ranges too.
    """
    rows = stored(df, "rows")  # so that rows get the same numbers again if a task is repeated
    parts = parts or max(-(-rows.count() // ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order] + [F.asc("__at")]
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    so_far = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(before)
    offsets = sums.select("__part", F.coalesce(so_far("__sum"), F.lit(0)).alias("__before"), F.coalesce(so_far("__n"), F.lit(0)).alias("__rows"))
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "__part").withColumn(total, F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    if place:
        out = out.withColumn(place, F.col("__rows") + F.count("*").over(within))
    return out.select(*df.columns, total, *([place] if place else []))
