"""Findings that follow a stream of changes, in a table to which every batch can be applied again without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from ..schemas import FINDINGS
from ..storage import drop, exists

TOUCHED = "rel string, change string, at timestamp"


class FindingsTable:
    """A folder of findings and touched files, both by batch. A file's findings are those of the last batch that touched it.

    A batch that is applied again overwrites its own folders and no other. Its findings are written before the list of files it
    touched, and only that list makes them count. compact() puts all batches so far into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, what: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/batch={batch}")

    def _read(self, what: str, shape: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{what}"):
            return self.spark.createDataFrame([], f"{shape}, batch long")
        return self.spark.read.schema(f"{shape}, batch long").parquet(f"{self.path}/{what}")

    def apply(self, changes: DataFrame, batch: int, read: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame] = matching.scan) -> None:
        """changes: rel, change. read: files of the given rel that are still there; scan: their findings."""
        at = "last_at" if "last_at" in changes.columns else "change"  # of changes without a time, one that isn't a deletion: the file's absence shows when it is read
        last = changes.groupBy("rel").agg(F.max_by("change", at).alias("change"))
        self._write(last.select("rel", "change", F.current_timestamp().alias("at")), "pending", batch)
        own = self.spark.read.schema(TOUCHED).parquet(f"{self.path}/pending/batch={batch}")
        self._write(scan(read(own.where("change <> 'deleted'").select("rel"))), "findings", batch)
        self._write(own, "touched", batch)
        drop(self.spark, f"{self.path}/pending/batch={batch}")

    def touched(self) -> DataFrame:
        return self._read("touched", TOUCHED)

    def latest(self) -> DataFrame:
        return self.touched().groupBy("rel").agg(F.max("batch").alias("batch"), F.max_by("change", "batch").alias("change"))

    def current(self) -> DataFrame:
        """The findings as of now."""
        alive = self.latest().where("change <> 'deleted'").select("rel", "batch")
        return self._read("findings", FINDINGS).join(alive, ["rel", "batch"]).select(*[c.split()[0] for c in FINDINGS.split(", ")])

    def compact(self) -> None:
        """Moves what counts of all batches into the last of them, then drops the others. Not while a stream writes to the table."""
        last = self.touched().agg(F.max("batch")).first()[0]
        if last is None:
            return
        kept, files = f"{self.path}/compacted-findings", f"{self.path}/compacted-touched"
        self.current().write.mode("overwrite").parquet(kept)
        self.latest().where("change <> 'deleted'").select("rel", "change", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(files)
        batches = [r.batch for r in self.touched().select("batch").distinct().collect()]
        self._write(self.spark.read.schema(FINDINGS).parquet(kept), "findings", last)
        self._write(self.spark.read.schema(TOUCHED).parquet(files), "touched", last)
        for b in batches:
            if b != last:
                drop(self.spark, f"{self.path}/touched/batch={b}")
                drop(self.spark, f"{self.path}/findings/batch={b}")
        drop(self.spark, kept)
        drop(self.spark, files)

    def recent_changes(self, most: int = 50) -> DataFrame:
        """The last changes, newest batch first."""
        return self.touched().orderBy(F.desc("batch"), F.desc("at"), "rel").limit(most)

    def recent_scans(self, most: int = 10) -> DataFrame:
        """batch, at, files, deleted, findings of the last scans. A batch of deletions alone scans nothing and doesn't count."""
        last = self.touched().groupBy("batch").agg(F.max("at").alias("at"), F.count_if(F.col("change") != "deleted").alias("files"), F.count_if(F.col("change") == "deleted").alias("deleted"))
        last = last.where("files > 0").orderBy(F.desc("batch")).limit(most)
        found = self._read("findings", FINDINGS).groupBy("batch").agg(F.count("*").alias("findings"))
        return last.join(found, "batch", "left").withColumn("findings", F.coalesce("findings", F.lit(0))).orderBy(F.desc("batch"))


def follow(changes: DataFrame, table: FindingsTable, read: Callable[[DataFrame], DataFrame], checkpoint: str, scan: Callable[[DataFrame], DataFrame] = matching.scan, seconds: float = 1.0):
    """A writer that keeps `table` up with a stream of changes; start() it."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            table.apply(df, batch_id, read, scan)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
