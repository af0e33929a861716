"""Expansion of query words on the dictionary.

A word of the query stands for itself, for all words that start with it, or for
those within an edit distance. The dictionary is small beside the postings; what it
gives is brought to the driver if it is within a bound - then the words are
literals that the scan of the postings can use - and stays a table beyond it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.index import Index

#: Matched words that the driver takes.
MOST_WORDS = 5_000


def matches(token: str, exact: bool, tolerance: int):
    term = F.col("term")
    if exact:
        return term == token
    if tolerance > 0:
        close = F.abs(F.length("term") - len(token)) <= tolerance
        return (close & (F.levenshtein(term, F.lit(token), tolerance) >= 0)) | term.startswith(token)
    return term.startswith(token)


def _few(index: Index, tokens: list[str], props: list[str], exact: bool, tolerance: int) -> tuple[list[tuple] | None, DataFrame]:
    """The matched words with their weights, if the driver can hold them; the table of i, token, prop, term, df."""
    n = index.n_docs
    base = index.terms.where(F.col("prop").isin(props))
    parts = [base.where(matches(t, exact, tolerance)).select(F.lit(i).alias("i"), F.lit(t).alias("token"), "prop", "term", "df") for i, t in enumerate(tokens)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    rows = out.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        return None, out
    own = {(r["i"], r["prop"]): r["df"] for r in rows if r["term"] == r["token"]}
    weigh = lambda df: math.log1p((n - df + 0.5) / (df + 0.5))
    found = []
    for r in rows:
        w = weigh(r["df"])
        mine = own.get((r["i"], r["prop"]))
        down = 1.0 if r["term"] == r["token"] else 0.5 if mine is None or w == 0 else 0.5 * min(1.0, weigh(mine) / w)
        found.append((r["i"], r["token"], r["prop"], r["term"], r["df"], w, down))
    return found, out


def matched(index: Index, tokens: list[str], props: list[str], exact: bool = False, tolerance: int = 0, boost: dict[str, float] | None = None) -> DataFrame:
    """The postings of the matched words: prop, term, seq, tf, len, i, idf, demotion,
    average (length of the field), boost.

    Few words are sent to the postings, which are never shuffled for them, and are a
    filter besides, which goes down to the scan.
    """
    post = index.postings.where(F.col("prop").isin(props))
    facts = {p: (float(index.averages.get(p) or 1.0), float((boost or {}).get(p, 1))) for p in props}
    found, out = _few(index, tokens, props, exact, tolerance)
    if found is not None:
        rows = [(prop, term, i, idf, down, *facts[prop]) for i, _, prop, term, _, idf, down in found]
        words = index.spark.createDataFrame(rows, "prop string, term string, i int, idf double, demotion double, average double, boost double")
        return post.where(F.col("term").isin(sorted({r[1] for r in rows}))).join(F.broadcast(words), ["prop", "term"])
    n = index.n_docs
    per_prop = index.spark.createDataFrame([(p, *f) for p, f in facts.items()], "prop string, average double, boost double")
    mine = out.where("term = token").select("i", "prop", F.col("df").alias("own"))
    words = out.join(F.broadcast(mine), ["i", "prop"], "left").join(F.broadcast(per_prop), "prop")
    demotion = scoring.demotion(F.col("term"), F.col("token"), F.col("own"), F.col("df"), n)
    return post.join(words.select("prop", "term", "i", scoring.idf(F.col("df"), n).alias("idf"), demotion.alias("demotion"), "average", "boost"), ["prop", "term"])
