"""Tables that a job writes for itself: they cut lineage and outlive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='stratalode-')}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration: keep() writes one and drops those that two later ones have replaced, so that disk holds a few of them only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, what: str, most: int = 2) -> DataFrame:
        path = folder(self.spark, f"{self.name}-{what}")
        df.write.parquet(path)
        own = self.paths.setdefault(what, [])
        own.append(path)
        while len(own) > most:
            drop(self.spark, own.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)
