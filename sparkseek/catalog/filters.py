"""Queries of filters: one a comparison, and their combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Where
from ..sources.index import Index
from .base import PARTS_SQL, documents, index_sql, kept, parts, table, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _parts(name: str, where: dict, sql: str) -> None:
    """All parts that pass."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = parts(spark, sf_dir)
        return Where(ix, where).apply(ix.docs).select("p_partkey", "p_name", "p_size", "p_retailprice")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {PARTS_SQL} SELECT p_partkey, p_name, p_size, p_retailprice FROM docs WHERE {sql}"


_parts("where_gt", {"p_size": {"gt": 30}}, "p_size > 30")
_parts("where_gte", {"p_size": {"gte": 30}}, "p_size >= 30")
_parts("where_lt", {"p_retailprice": {"lt": 950.5}}, "p_retailprice < 950.5")
_parts("where_lte", {"p_size": {"lte": 3}}, "p_size <= 3")
_parts("where_eq", {"p_size": {"eq": 17}}, "p_size = 17")
_parts("where_between", {"p_retailprice": {"between": [920, 960]}}, "p_retailprice BETWEEN 920 AND 960")
_parts("where_number_array", {"sizes": {"gt": 90}}, "len(list_filter(sizes, lambda x: x > 90)) > 0")
_parts("where_boolean", {"large": True}, "large")
_parts("where_enum_eq", {"p_brand": {"eq": "Brand#3"}}, "p_brand = 'Brand#3'")
_parts("where_enum_in", {"p_brand": {"in": ["Brand#3", "Brand#17"]}}, "p_brand IN ('Brand#3', 'Brand#17')")
_parts("where_enum_nin", {"p_brand": {"nin": ["Brand#3", "Brand#17"]}}, "p_brand NOT IN ('Brand#3', 'Brand#17')")
_parts("where_contains_all", {"words": {"containsAll": ["red", "widget"]}}, "list_has_all(words, ['red', 'widget'])")
_parts("where_contains_any", {"words": {"containsAny": ["red", "ring"]}}, "list_has_any(words, ['red', 'ring'])")
_parts("where_contains_none", {"words": {"containsAll": []}}, "false")
_parts("where_string", {"p_name": "Red RING"}, "list_has_any(words, ['red', 'ring'])")
_parts("where_string_list", {"p_name": ["red", "hot bolt"]}, "list_has_any(words, ['red', 'hot', 'bolt'])")
_parts("where_implicit_and", {"p_size": {"gt": 10}, "p_type": "economy"}, "p_size > 10 AND lower(p_type) = 'economy'")
_parts("where_and", {"and": [{"p_size": {"gt": 10}}, {"large": False}]}, "p_size > 10 AND NOT large")
_parts("where_or", {"or": [{"p_size": {"lt": 3}}, {"p_name": "ring"}]}, "p_size < 3 OR list_contains(words, 'ring')")
_parts("where_or_empty", {"or": []}, "false")
_parts("where_not", {"not": {"p_name": "ring"}}, "NOT list_contains(words, 'ring')")
_parts(
    "where_nested",
    {"and": [{"or": [{"p_brand": {"eq": "Brand#3"}}, {"not": {"p_size": {"lte": 40}}}]}, {"not": {"and": [{"words": {"containsAny": ["blue"]}}, {"large": True}]}}]},
    "(p_brand = 'Brand#3' OR NOT p_size <= 40) AND NOT (list_contains(words, 'blue') AND large)",
)
#: "and" takes precedence over what stands beside it.
_parts("where_precedence", {"and": [{"p_size": {"gt": 45}}], "p_brand": {"eq": "Brand#3"}}, "p_size > 45")


def where_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value meets no filter, so not holds for it; nin does not."""

    def build() -> Index:
        d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
        return Index.build(d.select("doc_id", (F.col("doc_id") + 1).alias("seq"), "quality", (F.col("toxic") == 1).alias("toxic"), F.col("quality").cast("string").alias("grade")), {"quality": "number", "toxic": "boolean", "grade": "enum"})

    ix = kept(spark, sf_dir, "labels", build)
    tests = {"good": {"quality": {"eq": 1}}, "not_good": {"not": {"quality": {"eq": 1}}}, "not_toxic": {"not": {"toxic": True}}, "grade_nin": {"grade": {"nin": ["1"]}}}
    return ix.docs.select("doc_id", *[Where(ix, w).predicate.alias(k) for k, w in tests.items()])


QUERIES["where_missing"] = where_missing
ORACLES["where_missing"] = """SELECT doc_id, coalesce(quality = 1, false) AS good, NOT coalesce(quality = 1, false) AS not_good, NOT coalesce(toxic = 1, false) AS not_toxic, coalesce(quality <> 1, false) AS grade_nin
FROM documents LEFT JOIN labels USING (doc_id)"""


def where_text_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text filter is a semi-join with the postings."""
    ix = documents(spark, sf_dir)
    return Where(ix, {"and": [{"text": "hean hees"}, {"n_chars": {"gte": 400}}]}).apply(ix.docs).select("doc_id", "lang")


QUERIES["where_text_of_documents"] = where_text_of_documents
ORACLES["where_text_of_documents"] = f"WITH {index_sql({'text': words_sql('text')})} SELECT doc_id, lang FROM docs WHERE n_chars >= 400 AND seq IN (SELECT seq FROM tf WHERE term IN ('hean', 'hees'))"


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).get("18").select("doc_id", "id", "lang", "n_chars")


QUERIES["get_by_id"], ORACLES["get_by_id"] = get_by_id, "SELECT doc_id, (doc_id + 1)::VARCHAR AS id, lang, n_chars FROM documents WHERE doc_id = 17"


def count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).docs.agg(F.count("*").alias("count"))


QUERIES["count_documents"], ORACLES["count_documents"] = count_documents, "SELECT count(*) AS count FROM documents"


def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of structs have dotted paths."""

    def build() -> Index:
        p = table(spark, sf_dir, "part")
        meta = F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("maker")).alias("meta")
        return Index.build(p.select("p_partkey", (F.col("p_partkey") + 1).alias("seq"), meta), {"meta": {"size": "number", "maker": {"brand": "enum"}}})

    ix = kept(spark, sf_dir, "nested parts", build)
    return Where(ix, {"meta.size": {"gt": 40}, "meta.maker.brand": {"in": ["Brand#3", "Brand#9"]}}).apply(ix.docs).select("p_partkey", F.col("meta.size").alias("size"))


QUERIES["nested_paths"] = nested_paths
ORACLES["nested_paths"] = "SELECT p_partkey, p_size AS size FROM part WHERE p_size > 40 AND p_brand IN ('Brand#3', 'Brand#9')"


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union and difference of the documents that two filters take."""
    ix = parts(spark, sf_dir)
    a, b = (Where(ix, w).apply(ix.docs).select("p_partkey") for w in ({"p_size": {"gt": 25}}, {"words": {"containsAny": ["red"]}}))
    both = {"intersection": a.intersect(b), "union": a.union(b).distinct(), "difference": a.exceptAll(b)}
    out = None
    for k, rows in both.items():
        one = rows.select(F.lit(k).alias("kind"), "p_partkey")
        out = one if out is None else out.unionAll(one)
    return out


QUERIES["set_operations"] = set_operations
ORACLES["set_operations"] = f"""WITH {PARTS_SQL}, a AS (SELECT p_partkey FROM docs WHERE p_size > 25), b AS (SELECT p_partkey FROM docs WHERE list_contains(words, 'red'))
SELECT 'intersection' AS kind, p_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', p_partkey FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'difference', p_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
