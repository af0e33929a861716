"""An index kept current from a log of upserts and deletes.

A log row is (offset, op, id, columns of a document); op is upsert or delete. The
order of the log decides, not time. Each micro-batch is folded to its last
operation an id - a partial aggregate, so a busy id is no task's whole work - and
turned into a new version of the documents by an anti-join and a union.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import Index
from ..sources.numbering import numbered


def latest(ops: DataFrame) -> DataFrame:
    """The last operation of each id."""
    rest = [c for c in ops.columns if c != "id"]
    return ops.groupBy("id").agg(F.max_by(F.struct(*rest), "offset").alias("o")).select("id", *[f"o.{c}" for c in rest])


def apply_ops(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """docs after the operations: rows of touched ids go, upserts come."""
    last = latest(ops)
    columns = [c for c in docs.columns if c in last.columns]
    kept = docs.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.where("op = 'upsert'").select(*columns), allowMissingColumns=True)


def read_through(snapshot: DataFrame, pending: DataFrame) -> DataFrame:
    """What a reader sees who has to see operations that no version holds yet."""
    return apply_ops(snapshot, pending)


def apply_to_index(index: Index, ops: DataFrame) -> Index:
    """A new version of an index; documents that come again take new places in order."""
    last = latest(ops)
    out = index.remove(last.select("id"))
    fresh = last.where("op = 'upsert'").select(*[c for c in index.docs.columns if c in last.columns and c != "seq"], "offset")
    top = index.docs.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    placed = numbered(fresh, "seq", [F.col("offset")]).withColumn("seq", F.col("seq") + top).drop("offset")
    return out.with_rows(placed)


class Follower:
    """Follows a log in files; after each micro-batch, `publish` gets the documents.

    The documents are a table in a folder for each batch number; a batch that runs
    again after a failure writes its own folder anew from the one before it.
    """

    def __init__(self, spark: SparkSession, log: str, schema: str, folder: str, publish: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.log, self.schema, self.folder, self.publish = spark, log, schema, folder.rstrip("/"), publish

    def _at(self, batch: int) -> str:
        return f"{self.folder}/documents-{batch}"

    def _fold(self, ops: DataFrame, batch: int) -> None:
        columns = [f.name for f in ops.schema.fields if f.name not in ("op", "offset")]
        before = self.spark.read.parquet(self._at(batch - 1)) if batch else self.spark.createDataFrame([], ops.select(*columns).schema)
        apply_ops(before, ops).write.mode("overwrite").parquet(self._at(batch))
        if self.publish:
            self.publish(self.spark.read.parquet(self._at(batch)), batch)

    def start(self, files_a_batch: int = 1_000, trigger: dict | None = None) -> StreamingQuery:
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_a_batch).json(self.log)
        return rows.writeStream.foreachBatch(self._fold).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def documents(self) -> DataFrame:
        """The documents after the last batch."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents-*"))
        last = max(int(f.getPath().getName().rsplit("-", 1)[1]) for f in found)
        return self.spark.read.parquet(self._at(last))


def follow_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total: counts by time window, late rows up to a bound."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
