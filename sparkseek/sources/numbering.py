"""Global and per-key row numbers without one task that sees all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, out: str, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`: 1 up by the given values (ascending), over all rows or a key's.

    Rows are dealt to ranges of the order. A range (of a key) is numbered for
    itself and moved up by the counts of the ranges before it: windows span one
    range of rows, or one row a range, so a key with a third of all rows is like
    any other.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order, strict=True)))
    dealt = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = dealt.groupBy("_part", *within).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")
    starts = counts.select(F.col("_part").alias("_p"), *[F.col(w).alias(f"_w{i}") for i, w in enumerate(within)], start)
    on = F.col("_part") == F.col("_p")
    for i, w in enumerate(within):
        on = on & F.col(w).eqNullSafe(F.col(f"_w{i}"))
    n = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*keys))
    # Without a key there is one row a range.
    placed = dealt.withColumn("_n", n).join(starts if within else F.broadcast(starts), on)
    return placed.select(*df.columns, (F.col("_n") + F.col("_start")).cast("long").alias(out))
