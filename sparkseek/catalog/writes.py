"""Queries of changes: inserts, updates, removals, op logs, saved indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.search import search
from ..sources.imports import with_ids
from ..sources.index import Index
from ..sources.store import Versions, compact
from ..streaming import oplog
from .base import documents, scored, shared_folder, table, text_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_HOW = {"term": "hean und", "properties": ["text"], "prefix": False, "limit": 25}
_SEQ = "seq, round(score, 6) AS score"


def _page(index: Index) -> DataFrame:
    return scored(search(index, **_HOW).hits, "seq")


def _of_version(name: str, docs: str, change) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _page(change(spark, sf_dir, documents(spark, sf_dir)))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, text_sql(["hean", "und"], select=_SEQ, limit=25, docs=docs, mode="exact")


def _fresh(ix: Index) -> DataFrame:
    """New texts for French documents, and copies of Spanish ones under new ids."""
    old = ix.docs.where("lang = 'fr'").withColumn("text", F.concat(F.lit("hean und "), F.col("source")))
    new = ix.docs.where("lang = 'es'").withColumn("id", F.concat(F.lit("n"), F.col("id")))
    return old.unionByName(new).drop("seq")


_base = "b AS (SELECT doc_id + 1 AS seq, (doc_id + 1)::VARCHAR AS id, text, lang, source FROM documents), top AS (SELECT max(seq) AS top FROM b)"
_old = "SELECT id, 'hean und ' || source AS text FROM b WHERE lang = 'fr'"
_new = "SELECT 'n' || id AS id, text FROM b WHERE lang = 'es'"
_numbered = "SELECT top + row_number() OVER (ORDER BY id) AS seq, text FROM f CROSS JOIN top"
_of_version("insert_rows", f"{_base}, f AS ({_new}), docs AS (SELECT seq, text FROM b UNION ALL {_numbered})", lambda spark, d, ix: ix.insert(_fresh(ix).where("id LIKE 'n%'")))
_of_version("upsert_rows", f"{_base}, f AS ({_old} UNION ALL {_new}), docs AS (SELECT seq, text FROM b WHERE lang <> 'fr' UNION ALL {_numbered})", lambda spark, d, ix: ix.upsert(_fresh(ix)))
_of_version("update_rows", f"{_base}, f AS ({_old}), docs AS (SELECT seq, text FROM b WHERE lang <> 'fr' UNION ALL {_numbered})", lambda spark, d, ix: ix.update(_fresh(ix).where("lang = 'fr'")))
_of_version("remove_rows", f"{_base}, docs AS (SELECT seq, text FROM b WHERE source <> 'src3' AND lang <> 'fr')", lambda spark, d, ix: ix.remove(ix.docs.where("source = 'src3' OR lang = 'fr'").select("id")))
_of_version("freeze_roundtrip", f"{_base}, docs AS (SELECT seq, text FROM b WHERE source <> 'src3')", lambda spark, d, ix: compact(ix.remove(ix.docs.where("source = 'src3'").select("id")), f"{shared_folder(spark)}/frozen"))


def _published(spark: SparkSession, sf_dir: str, ix: Index) -> Index:
    """Saved twice; the second version is the one that is read."""
    import uuid

    versions = Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    versions.publish(ix.remove(ix.docs.where("lang = 'en'").select("id")))
    versions.publish(ix)
    return versions.load()


_of_version("save_and_load", f"{_base}, docs AS (SELECT seq, text FROM b)", _published)

# -- logs ----------------------------------------------------------------------------------


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: an error deletes the user's document, all else replaces it."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), op.alias("op"), F.concat(F.lit("u"), "user_id").alias("id"), F.col("event_type").alias("kind"), "value")


_SQL_OPS = "ops AS (SELECT event_id AS \"offset\", CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, 'u' || user_id AS id, event_type AS kind, value FROM events)"
_SQL_LAST = "l AS (SELECT id, arg_max(op, \"offset\") AS op, arg_max(kind, \"offset\") AS kind, arg_max(value, \"offset\") AS value FROM ops GROUP BY id)"


def oplog_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _ops(spark, sf_dir)
    empty = ops.where("false").select("id", "kind", "value")
    return oplog.apply_ops(empty, ops)


QUERIES["oplog_latest_wins"], ORACLES["oplog_latest_wins"] = oplog_latest_wins, f"WITH {_SQL_OPS}, {_SQL_LAST} SELECT id, kind, value FROM l WHERE op = 'upsert'"


def oplog_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of every user, under the operations since."""
    k = F.col("c_custkey")
    snapshot = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), k).alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("value"))
    return oplog.read_through(snapshot, _ops(spark, sf_dir).where("kind <> 'view'"))


QUERIES["oplog_read_through"] = oplog_read_through
ORACLES["oplog_read_through"] = f"""WITH {_SQL_OPS.replace('FROM events)', "FROM events WHERE event_type <> 'view')")}, {_SQL_LAST}, s AS (SELECT 'u' || c_custkey AS id, c_mktsegment AS kind, c_acctbal AS value FROM customer)
SELECT * FROM s WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, kind, value FROM l WHERE op = 'upsert'"""


def oplog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as files, followed by a streaming query in micro-batches."""
    import uuid

    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    _ops(spark, sf_dir).repartitionByRange(4, "offset").write.json(f"{folder}/log")
    follower = oplog.Follower(spark, f"{folder}/log", "offset long, op string, id string, kind string, value double", f"{folder}/state")
    # One file a batch; files of a later range of offsets come later by name only, so the fold is by offset.
    follower.start(files_a_batch=4).awaitTermination()
    return follower.documents().select("id", "kind", "value")


QUERIES["oplog_stream"], ORACLES["oplog_stream"] = oplog_stream, ORACLES["oplog_latest_wins"]


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = oplog.follow_events(table(spark, sf_dir, "events"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES["event_windows"] = event_windows
ORACLES["event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def import_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from names, numbered where they repeat; a few names take most rows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit(" & Co. ("), F.col("c_nationkey"), F.lit(")")).alias("company_name"))
    return with_ids(rows, "c_custkey").select("c_custkey", "id")


QUERIES["import_ids"] = import_ids
ORACLES["import_ids"] = r"""WITH b AS (SELECT c_custkey, regexp_replace(regexp_replace(lower(c_mktsegment || ' & Co. (' || c_nationkey || ')'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS n FROM b) SELECT c_custkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM n"""
