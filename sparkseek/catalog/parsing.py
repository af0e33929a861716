"""Queries that parse documents or derive keys from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_bytes, slugify
from ..sources import markup, shards
from .base import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def html_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages (tests hold the parser against known trees)."""
    return markup.html_records(table(spark, sf_dir, "pages"), "page_id")


def html_records_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_records(table(spark, sf_dir, "pages"), "page_id", merge="split").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: a heading with the source, one with the language."""
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## In "), F.col("lang"), F.lit(" {#body}\n\n"), F.col("text"))
    return markup.markdown_sections(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")


def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents' headings alone."""
    rows = markdown_sections(spark, sf_dir).where("anchor = 'body' OR level = 1")
    return rows.select("doc_id", "title", "place", "heading", "anchor", "level", F.array_join("ancestors", " > ").alias("ancestors"))


QUERIES |= {f.__name__: f for f in (html_records, html_records_split, markdown_sections, markdown_headings)}
ORACLES["markdown_headings"] = """SELECT doc_id, source AS title, 0::INTEGER AS place, source AS heading, source AS anchor, 1::INTEGER AS level, '' AS ancestors FROM documents
UNION ALL SELECT doc_id, source, 1, 'In ' || lang, 'body', 2, source FROM documents"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", slugify(F.concat_ws(" / ", "p_brand", "p_type", "p_name")).alias("slug"))


QUERIES["slugs"] = slugs
ORACLES["slugs"] = "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"


def shard_route_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit("é")).alias("id"))
    return shards.route(rows, 16).select("doc_id", shards.fnv1a32(F.col("id")).alias("hash"), F.col("shard").cast("long").alias("shard"))


QUERIES["shard_route_fnv"] = shard_route_fnv
ORACLES["shard_route_fnv"] = """WITH h AS (SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('doc-' || doc_id || 'é', ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM documents)
SELECT doc_id, hash, hash % 16 AS shard FROM h"""


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as partitions, small ones on one shard."""
    return shards.packed_partitions(table(spark, sf_dir, "documents"), "source", most=100)


QUERIES["shard_sizes"] = shard_sizes
ORACLES["shard_sizes"] = "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, ((sum(n) OVER (ORDER BY source) - n) // 100)::BIGINT AS shard FROM s"


def shard_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shards can hold a match of each comparison, by their ranges alone."""
    ranges = shards.number_ranges(shards.route(table(spark, sf_dir, "part").withColumn("id", F.col("p_type")), 8), "shard", ["p_size", "p_retailprice"])
    tests = [("p_size", "gt", 49), ("p_size", "between", [50, 60]), ("p_retailprice", "lt", 905), ("p_retailprice", "eq", 900.0)]
    out = None
    for prop, op, value in tests:
        one = shards.may_match(ranges, prop, op, value).select(F.lit(f"{prop} {op}").alias("test"), F.col("shard").cast("long").alias("shard"))
        out = one if out is None else out.unionAll(one)
    return out


QUERIES["shard_pruning"] = shard_pruning
ORACLES["shard_pruning"] = """WITH h AS (SELECT *, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_type, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 8 AS shard FROM part),
r AS (SELECT shard, min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM h GROUP BY shard)
SELECT 'p_size gt' AS test, shard FROM r WHERE b > 49 UNION ALL SELECT 'p_size between', shard FROM r WHERE a <= 60 AND b >= 50
UNION ALL SELECT 'p_retailprice lt', shard FROM r WHERE c < 905 UNION ALL SELECT 'p_retailprice eq', shard FROM r WHERE c <= 900 AND d >= 900"""


def bloom_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash by which a Bloom filter of words places each source."""
    rows = table(spark, sf_dir, "documents").select("source").distinct()
    return rows.select("source", shards.mixed32(shards.fnv1a32(F.col("source"))).alias("hash"))


QUERIES["bloom_hashes"] = bloom_hashes
ORACLES["bloom_hashes"] = """WITH h AS (SELECT source, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(source, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM (SELECT DISTINCT source FROM documents)),
a AS (SELECT source, (xor(h, h // 65536) * 2246822507) % 4294967296 AS h FROM h), b AS (SELECT source, (xor(h, h // 8192) * 3266489909) % 4294967296 AS h FROM a)
SELECT source, xor(h, h // 65536)::BIGINT AS hash FROM b"""


def bytes_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's texts, in bytes that a person reads."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n"))
    return sizes.select("source", format_bytes(F.col("n")).alias("size"), format_bytes(F.col("n"), 0).alias("whole"))


QUERIES["bytes_in_words"] = bytes_in_words
ORACLES["bytes_in_words"] = """WITH s AS (SELECT source, sum(strlen(text))::BIGINT AS n FROM documents GROUP BY source),
u AS (SELECT *, CASE WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS i FROM s), v AS (SELECT *, n / pow(1024, i) AS x, ['Bytes', 'KB', 'MB'][i + 1] AS unit FROM u)
SELECT source, CASE WHEN i = 0 THEN n::VARCHAR ELSE regexp_replace(round(x, 2)::DECIMAL(18, 2)::VARCHAR, '\\.?0+$', '') END || ' ' || unit AS size, round(x)::BIGINT::VARCHAR || ' ' || unit AS whole FROM v"""
