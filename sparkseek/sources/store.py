"""Saved indexes: formats, versions, and the files that a search has to read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from .index import Index

FORMATS = ("parquet", "orc", "json")


def persist(df: DataFrame, path: str, kind: str = "parquet", rows_a_file: int = 0) -> None:
    """Any table in one of the formats, to any file system that Spark knows."""
    if kind not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}, not {kind}")
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).format(kind).save(path)


def restore(spark: SparkSession, path: str, kind: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(path)


class Versions:
    """An index's saved versions: folders, and a small table of which one is live.

    A version is written whole before it becomes live, so readers see one or the
    other; the live version is the last one entered.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def entries(self) -> DataFrame:
        return self.spark.read.schema("number long, name string").parquet(f"{self.path}/live")

    def live(self) -> str | None:
        if not self._exists(f"{self.path}/live"):
            return None
        row = self.entries().orderBy(F.desc("number")).first()
        return row and f"{self.path}/{row['name']}"

    def publish(self, index: Index) -> str:
        number = (self.entries().agg(F.max("number")).first()[0] or 0) + 1 if self._exists(f"{self.path}/live") else 1
        name = f"version-{number}-{uuid.uuid4().hex[:8]}"
        index.save(f"{self.path}/{name}")
        self.spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{self.path}/live")
        return f"{self.path}/{name}"

    def load(self, analyzer: Analyzer | None = None) -> Index:
        at = self.live()
        if at is None:
            raise FileNotFoundError(self.path)
        return Index.load(self.spark, at, analyzer)


def compact(index: Index, path: str) -> Index:
    """Rewrite an index with many changes as sorted tables, and read it back."""
    index.save(path)
    out = Index.load(index.spark, path, index.analyzer)
    out.pins, out.hooks, out.excluded = dict(index.pins), index.hooks, index.excluded
    return out
