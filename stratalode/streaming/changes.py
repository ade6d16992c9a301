"""File changes: between two listings, along a log of states, and as a stream with debounce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTING = "poll_id long, rel string, mtime double, digest string, size long"


def between(before: DataFrame, now: DataFrame) -> DataFrame:
    """rel, change from two listings: a newer mtime with an equal digest is no change, absence is deletion."""
    b = before.select(F.col("rel").alias("__r"), F.col("digest").alias("__d"), F.col("mtime").alias("__m"))
    j = now.select("rel", "digest", "mtime").join(b, F.col("rel") == F.col("__r"), "full_outer")
    change = F.when(F.col("__r").isNull(), "created").when(F.col("rel").isNull(), "deleted").when((F.col("mtime") > F.col("__m")) & (F.col("digest") != F.col("__d")), "modified")
    return j.select(F.coalesce("rel", "__r").alias("rel"), change.alias("change")).where("change is not null")


def from_log(states: DataFrame, key: str, at: str) -> DataFrame:
    """key, at, change along a log of (digest, gone) states of each key."""
    w = Window.partitionBy(key).orderBy(at)
    s = states.withColumns({"__p": F.lag("digest").over(w), "__g": F.lag("gone").over(w)})
    change = F.when(F.col("__p").isNull(), "created").when(F.col("gone"), "deleted").when(F.col("__g"), "created").otherwise("modified")
    return s.where(F.col("__p").isNull() | (F.col("digest") != F.col("__p"))).select(key, at, change.alias("change"))


def watch(listings: DataFrame, snapshot: str, on_change, checkpoint: str, quiet_seconds: float = 1.0, announce_first: bool = True):
    """Starts a stream over listings; each poll is compared with the snapshot table at `snapshot`, then replaces it.

    Deletions show as absence, so a batch is compared whole. on_change(changes, batch_id) gets the changes; a batch that is
    replayed hands on the same ones under the same number. What arrives within the trigger interval is one batch; for a quiet
    time of each file see debounce. Without announce_first the first listing is the state from which changes count, and hands on none.
    """
    spark = listings.sparkSession

    def poll(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id:
            before = spark.read.schema("rel string, mtime double, digest string, size long").parquet(f"{snapshot}/v{batch_id - 1}")
        last = batch.agg(F.max("poll_id")).first()[0]
        now = batch.where(F.col("poll_id") == last).select("rel", "mtime", "digest", "size")
        if last is None:  # no listing arrived: what was known stays
            now = before if before is not None else now
        elif before is not None:
            on_change(between(before, now), batch_id)
        elif announce_first:
            on_change(between(now.limit(0), now), batch_id)
        now.write.mode("overwrite").parquet(f"{snapshot}/v{batch_id}")

    return listings.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint).trigger(processingTime=f"{quiet_seconds} seconds")


def recorder(path: str):
    """An on_change that writes changes to `path` by batch, for a stream to read: rel, change, at."""

    def record(changes: DataFrame, batch_id: int) -> None:
        changes.select("rel", "change", F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return record
