"""Queries of measures and merges of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, merging
from ..operators.bm25 import TextQuery, ranked
from ..sources.numbering import numbered
from .base import documents, events_sql, index_sql, table, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each source as a query: its documents from long to short, judged by their labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    runs = numbered(docs, "rank", [-F.col("n_chars"), F.col("doc_id")], within=("source",))
    runs = runs.select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), "rank")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("rel"))
    qrels = docs.join(labels, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), "rel")
    return runs, qrels


_SQL = """r AS (SELECT source AS query, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
q AS (SELECT source AS query, doc_id AS doc, quality * 2 + toxic AS rel FROM documents JOIN labels USING (doc_id)),
f AS (SELECT r.query, rank, coalesce(rel, 0) AS rel FROM r LEFT JOIN q USING (query, doc)), g AS (SELECT *, sum((rel > 0)::INTEGER) OVER (PARTITION BY query ORDER BY rank) AS hits FROM f),
i AS (SELECT query, sum(rel / log2(k + 1)) FILTER (k <= 10) AS ideal, count(*) FILTER (rel > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC) AS k FROM q) GROUP BY query),
s AS (SELECT query, sum(rel / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum(CASE WHEN rel > 0 AND rank <= 100 THEN hits / rank ELSE 0 END) AS p, count(*) FILTER (rel > 0 AND rank <= 100) AS n, count(*) FILTER (rel > 0 AND rank <= 10) AS nk, min(rank) FILTER (rel > 0 AND rank <= 10) AS first FROM g GROUP BY query),
m AS (SELECT query, CASE WHEN ideal > 0 THEN dcg / ideal END AS ndcg, CASE WHEN relevant > 0 THEN p / relevant END AS map, CASE WHEN relevant > 0 THEN n / relevant END AS recall, nk / 10 AS precision, coalesce(1 / first, 0) AS mrr FROM i JOIN s USING (query))"""
_NAMES = ("ndcg", "map", "recall", "precision", "mrr")


def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.per_query(*_lists(spark, sf_dir))
    return rows.select("query", *[F.round(n, 6).alias(n) for n in _NAMES])


def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(*_lists(spark, sf_dir)).select(*[F.round(n, 6).alias(n) for n in _NAMES])


QUERIES |= {"eval_per_query": eval_per_query, "eval_means": eval_means}
ORACLES["eval_per_query"] = f"WITH {_SQL} SELECT query, " + ", ".join(f'round({n}, 6) AS "{n}"' for n in _NAMES) + " FROM m"
ORACLES["eval_means"] = f"WITH {_SQL} SELECT " + ", ".join(f'round(coalesce(avg({n}), 0), 6) AS "{n}"' for n in _NAMES) + " FROM m"


def _merged(threshold: float, keywords: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = documents(spark, sf_dir)
        lists = [ranked(ix, TextQuery(t, ["text"], prefix=False)) for t in ("hean", "und", "hees")]
        out = merging.prioritized(lists, 2.0, threshold, keywords)
        return out.select((F.col("seq") - 1).alias("doc_id"), F.round("score", 6).alias("score"))

    return run


_MERGED = f"""WITH {index_sql({'text': words_sql('text')})}, {events_sql(['hean', 'und', 'hees'], ['text'], 'exact')},
o AS (SELECT seq, count(*) AS n, list_reduce(list(w * 2 ORDER BY i), lambda a, x: a * 1.5 + x) AS score FROM ev GROUP BY seq)"""
QUERIES |= {"prioritize_all": _merged(1, 3), "prioritize_every_word": _merged(0, 3), "prioritize_half": _merged(0.5, 3)}
ORACLES["prioritize_all"] = f"{_MERGED} SELECT seq - 1 AS doc_id, round(score, 6) AS score FROM o"
ORACLES["prioritize_every_word"] = f"{_MERGED} SELECT seq - 1 AS doc_id, round(score, 6) AS score FROM o WHERE n = 3"
ORACLES["prioritize_half"] = f"""{_MERGED}, c AS (SELECT *, row_number() OVER (ORDER BY n DESC, round(score, 9) DESC, seq) AS r, greatest(count(*) FILTER (n = 3) OVER () - 1, 0) AS last, count(*) OVER () AS total FROM o)
SELECT seq - 1 AS doc_id, round(score, 6) AS score FROM c WHERE r <= least(total, last + ceil(0.5 * (total - last)))"""
