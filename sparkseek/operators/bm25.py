"""BM25 ranking: joins of expanded words and postings, and one aggregate."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SeekError
from ..functions.scoring import Bm25, bm25
from ..sources.index import Index
from ..sources.numbering import numbered
from .expand import matched

#: Partial matches that are cut by a top-k; beyond, by a distributed numbering.
MOST_HELD = 10_000


@dataclass
class TextQuery:
    term: str
    properties: list[str] | str = "*"
    exact: bool = False
    prefix: bool = True
    tolerance: int = 0
    threshold: float = 1.0
    boost: dict[str, float] | None = None
    relevance: Bm25 = Bm25()


def searched(index: Index, properties) -> list[str]:
    every = index.schema.strings()
    if properties in (None, "*"):
        return every
    for p in properties:
        if p not in every:
            raise SeekError("UNKNOWN_INDEX", p)
    return list(properties)


def query_tokens(index: Index, q: TextQuery, props: list[str]) -> list[str]:
    return list(dict.fromkeys(index.analyzer.tokens(q.term))) or [""]


def events(index: Index, q: TextQuery, tokens: list[str], props: list[str]) -> DataFrame:
    """seq, prop, i, w: a row for each matched word of a document's field."""
    for p in props:
        if (q.boost or {}).get(p, 1) <= 0:
            raise SeekError("INVALID_BOOST_VALUE", p)
    exact = q.exact or (not q.prefix and not q.tolerance)
    post = matched(index, tokens, props, exact, 0 if q.exact else q.tolerance, q.boost)
    weight = bm25(F.col("tf"), F.col("idf"), F.col("len"), F.col("average"), q.relevance) * (F.col("demotion") * F.col("boost"))
    return post.select("seq", "prop", "i", weight.alias("w"))


def ranked(index: Index, q: TextQuery, allowed: DataFrame | None = None) -> DataFrame:
    """seq, score of the matching documents; allowed: seq of those to consider."""
    props = searched(index, q.properties)
    tokens = query_tokens(index, q, props)
    found = events(index, q, tokens, props)
    kept = found if allowed is None else found.join(allowed.select("seq"), "seq", "left_semi")
    n = len(tokens)
    if n == 1 or q.threshold >= 1:
        return _sum(kept)
    if q.threshold <= 0:
        # Fields in which some document of the whole collection has every word.
        cover = found.groupBy("seq", "prop").agg(F.countDistinct("i").alias("c")).where(F.col("c") == n)
        whole = cover.select("prop").distinct()
        holders = kept.groupBy("seq", "prop").agg(F.countDistinct("i").alias("c")).where(F.col("c") == n).select("seq").distinct()
        return _sum(kept.join(F.broadcast(whole), "prop", "left_semi").join(holders, "seq", "left_semi"))
    # Counted by (token, word) matches, as prefix expansion may hit twice.
    fields = kept.groupBy("seq", "prop").agg(F.count("*").alias("c"), F.sum("w").alias("w"))
    docs = fields.groupBy("seq").agg(F.sum("w").alias("score"), F.max((F.col("c") == n).cast("int")).alias("full"))
    sizes = docs.agg(F.sum("full").alias("n_full"), F.sum(1 - F.col("full")).alias("n_part"))
    n_full, n_part = sizes.first()
    if not n_full:
        return docs.select("seq", "score")
    take = math.ceil(round(q.threshold * n_part, 9))
    part = docs.where("full = 0").select("seq", "score")
    if take <= MOST_HELD:
        part = part.orderBy(F.desc(F.round("score", 9)), "seq").limit(take)
    else:
        part = numbered(part, "_n", [-F.round("score", 9), F.col("seq")]).where(F.col("_n") <= take).drop("_n")
    return docs.where("full = 1").select("seq", "score").unionAll(part)


def _sum(found: DataFrame) -> DataFrame:
    return found.groupBy("seq").agg(F.sum("w").alias("score"))


#: A word's edge as ASCII sees it.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def holds_exactly(index: Index, docs: DataFrame, q: TextQuery) -> DataFrame:
    """Documents one of whose stored searched fields has every word as it stands."""
    words = [w for w in re.split(r"\s+", q.term.strip()) if w]
    props = [p for p in searched(index, q.properties) if index.schema.fields[p] == "string"]
    stored = [p for p in props if p.split(".")[0] in index.docs.columns]
    if len(stored) < len(props) or not words:
        return docs
    test = F.lit(False)
    for p in stored:
        every = F.lit(True)
        for w in words:
            every = every & F.col(p).rlike(_EDGE + re.sub(r"([^\w\s])", r"\\\1", w) + _EDGE)
        test = test | F.coalesce(every, F.lit(False))
    return docs.where(test)
