"""Named queries over the test tables, each beside the SQL that says what it means.

A query is a function (spark, sf_dir) -> DataFrame; its SQL, where there is one,
gives the same rows in another engine.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "filters", "results", "vectors", "geo", "writes", "parsing", "measures")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")


def flagship(spark, sf_dir: str):
    """Three words in English documents: the ten best, with their texts' lengths."""
    from pyspark.sql import functions as F

    from ..plans.search import search
    from .base import documents

    found = search(documents(spark, sf_dir), term="the anon hees", properties=["text"], where={"lang": {"eq": "en"}})
    return found.hits.select("doc_id", "lang", "source", "n_chars", F.round("score", 6).alias("score"))
