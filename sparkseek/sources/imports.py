"""Documents from files: JSON arrays, JSON lines, {"data": [...]}, and their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import numbered


def slug(name) -> F.Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def read_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rows of JSON lines or, with multiline, of one array or of {"data": [...]}."""
    df = spark.read.option("multiLine", multiline).json(path)
    if multiline and df.columns == ["data"] and isinstance(df.schema["data"].dataType, T.ArrayType):
        df = df.select(F.explode("data").alias("d")).select("d.*")
    return df


def with_ids(docs: DataFrame, order: str, id_field: str = "id", name_field: str = "company_name") -> DataFrame:
    """docs with a text `id`: its own, or the slug of its name, -2, -3 … for repeats
    in the given order. A row without either is "document"."""
    own = F.col(id_field).cast("string") if id_field in docs.columns else F.lit(None).cast("string")
    name = F.col(name_field).cast("string") if name_field in docs.columns else F.lit(None).cast("string")
    base = slug(F.coalesce(name, F.lit("document")))
    rows = docs.withColumn("_own", F.when(F.length(own) > 0, own)).withColumn("_base", F.when(base == "", "document").otherwise(base))
    # Own ids take no number of a slug.
    rows = rows.withColumn("_key", F.when(F.col("_own").isNull(), F.col("_base")))
    rows = numbered(rows, "_n", [F.col(order)], within=("_key",))
    made = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))
    kept = [c for c in docs.columns if c != "id"]
    return rows.select(F.coalesce("_own", made).alias("id"), *kept)
