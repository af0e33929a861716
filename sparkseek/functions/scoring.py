"""BM25 as Column expressions and as plain Python."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    k: float = 1.2
    b: float = 0.75
    d: float = 0.5


def idf(df: Column, n_docs: int | Column) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, idf_: Column, length: Column, average: Column, p: Bm25 = Bm25()) -> Column:
    """d stands in the numerator with the saturated count, before the division."""
    return idf_ * (F.lit(p.d) + tf * (p.k + 1)) / (tf + p.k * (1 - p.b + p.b * length / average))


def bm25_value(tf: float, df: int, n_docs: int, length: float, average: float, p: Bm25 = Bm25()) -> float:
    w = math.log1p((n_docs - df + 0.5) / (df + 0.5))
    return w * (p.d + tf * (p.k + 1)) / (tf + p.k * (1 - p.b + p.b * length / average))


def demotion(term: Column, token: Column, token_df: Column, df: Column, n_docs: int) -> Column:
    """What a word that is not the token itself scores of its weight."""
    share = F.when(idf(df, n_docs) == 0, 0.5).otherwise(0.5 * F.least(F.lit(1.0), idf(token_df, n_docs) / idf(df, n_docs)))
    return F.when(term == token, 1.0).otherwise(F.coalesce(share, F.lit(0.5)))


def prioritize(scores: Column) -> Column:
    """Fold of repeated scores of one document, in order: old * 1.5 + new."""
    return F.aggregate(F.slice(scores, 2, F.greatest(F.size(scores), F.lit(1))), F.get(scores, 0), lambda acc, x: acc * 1.5 + x)
