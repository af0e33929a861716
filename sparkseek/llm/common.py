"""What the operators of this folder share: tables, the shared folder, sizes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark only (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none - local tests - a temporary one is set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster has to name a folder that its machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkseek-"))
    return jsc.getCheckpointDir().get().rstrip("/")


#: Options of tables of hashes, which a dictionary does not shorten.
HASHES = {"parquet.enable.dictionary": "false"}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


#: Tables of materialize() that are still there.
_written: list[str] = []


def mark() -> int:
    """What discard() takes to tell later tables from earlier ones."""
    return len(_written)


def discard(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables written since a mark, all but `kept`, and let Spark drop
    the shuffle files of queries that nothing refers to any more."""
    keep = {df._written_at for df in kept}
    gone = [p for p in _written[since:] if p not in keep]
    _written[since:] = [p for p in _written[since:] if p in keep]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    gc.collect()
    jvm.System.gc()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gives_back(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, for mapInArrow(): at a task's end the worker hands the memory it freed back
    to the machine, as it waits for more tasks while others work."""

    def wrapped(*args, **named) -> Iterator:
        try:
            yield from run(*args, **named)
        finally:
            _give_back()

    return wrapped


def pieces(rows: int, each: int) -> int:
    """Number of groups of about `each` rows, one at least."""
    return max(1, -(-rows // each))


def bit_filter(ids: DataFrame, column: str, bits: int = 1 << 22):
    """A test for columns that may hold one of the ids: fixed size, no misses.

    Ids are hashed into `bits` bits, which every task gets as one array of
    bits / 64 longs - 512 KB, whatever the input. It lets through all of the ids
    and of the other rows the share of bits set, so it only saves shuffling; an
    exact join has to follow.
    """
    spark = ids.sparkSession
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    words = ids.select(F.floor(h / 64).cast("long").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    filled = spark.range(0, bits // 64, 1, 1).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")).unionAll(words)
    filled = filled.groupBy("w").agg(F.bit_or("b").alias("b"))
    array = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("a")).scalar()

    def test(col):
        k = F.pmod(F.xxhash64(col), F.lit(bits))
        word = F.get(array, F.floor(k / 64).cast("int"))
        return F.call_function("shiftright", word, F.pmod(k, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component (its least reachable node) for the nodes of edges (a, b).

    Alternating large-star and small-star rounds. Least neighbours are
    aggregated before they are shuffled, so a hub's edges never meet in one
    task; each round is written to the shared folder.
    """
    spark, start = edges.sparkSession, mark()
    now = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    same = ("count(*) AS n", "coalesce(sum(cast(xxhash64(u, v) AS decimal(38, 0))), 0) AS s")
    before = now.selectExpr(*same).first()
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        after = now.selectExpr(*same).first()
        if after == before:
            discard(spark, start, now)
            break
        before = after
        discard(spark, start, now)
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(members.select(F.col("component").alias("node"), "component").distinct())
