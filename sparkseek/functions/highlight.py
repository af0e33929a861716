"""Marks, positions and snippets of a query's words in a text, as Columns.

Word edges are ASCII word edges and case is folded for all letters, whatever the
platform's own rules are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
STRATEGIES = ("partial", "whole", "full")
ELLIPSIS = "…"


def pattern(term: str, strategy: str = "partial", case_sensitive: bool = False) -> str | None:
    """The expression that finds a query's words; None for an empty query."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy}")
    words = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in term.split()]
    if not words:
        return None
    any_of = "|".join(words)
    body = {"partial": f"(?:{any_of})", "whole": f"{_EDGE}(?:{any_of}){_EDGE}", "full": rf"{_EDGE}[^\s]*(?:{any_of})[^\s]*{_EDGE}"}[strategy]
    return body if case_sensitive else f"(?iu){body}"


def marked(text: Column, term: str, strategy: str = "partial", tag: str = "mark", css: str = "sparkseek-highlight", case_sensitive: bool = False) -> Column:
    """The text with every match inside a tag."""
    p = pattern(term, strategy, case_sensitive)
    text = F.coalesce(text, F.lit(""))
    return text if p is None else F.regexp_replace(text, p, f'<{tag} class="{css}">$0</{tag}>')


def positions(text: Column, term: str, strategy: str = "partial", case_sensitive: bool = False) -> Column:
    """array<struct<start, end>> of the matches; end is inclusive."""
    p = pattern(term, strategy, case_sensitive)
    if p is None:
        return F.array().cast("array<struct<start:int,end:int>>")
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.transform(F.split(text, p, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), F.transform(found, lambda f: F.length(f)).alias("f"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    fold = F.aggregate(
        pairs,
        start,
        lambda a, x: F.struct((a["at"] + x["g"] + x["f"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["f"] - 1).alias("end")))).alias("out")),
    )
    return fold["out"]


def _first(text: Column, p: str) -> tuple[Column, Column]:
    """(start, length) of the first match; (-1, 0) where there is none."""
    found = F.regexp_extract(text, f"({p})" if not p.startswith("(?iu)") else f"(?iu)({p[5:]})", 1)
    start = F.length(F.get(F.split(text, p, 2), 0))
    return F.when(F.length(found) > 0, start).otherwise(F.lit(-1)), F.length(found)


def trimmed(text: Column, term: str, length: int, ellipsis: bool = True, strategy: str = "partial") -> Column:
    """About `length` characters around the first match, marked."""
    p = pattern(term, strategy)
    dots = "..." if ellipsis else ""
    whole = marked(text, term, strategy)
    n = F.length(text)
    cut = F.concat(F.substring(whole, F.lit(1), F.lit(length)), F.lit(dots))
    if p is None:
        return F.when(n <= length, whole).otherwise(cut)
    first, _ = _first(text, p)
    start = F.greatest(first - length // 2, F.lit(0))
    end = F.least(start + length, n)
    part = F.concat(F.when(start > 0, F.lit(dots)).otherwise(F.lit("")), F.substring(text, start + 1, end - start), F.when(end < n, F.lit(dots)).otherwise(F.lit("")))
    return F.when(n <= length, whole).when(first < 0, cut).otherwise(marked(part, term, strategy))


def snippet(text: Column, term: str, length: int = 160) -> Column:
    """A window of whole words around the first match, with … where it cuts."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    n = F.length(flat)
    p = pattern(term, "full")
    anchor, size = (F.lit(0), F.lit(0)) if p is None else _first(flat, p)
    anchor = F.greatest(anchor, F.lit(0))
    padding = F.floor((F.lit(length) - F.least(size, F.lit(length))) / 2).cast("int")
    end = F.least(n, F.greatest(F.lit(0), anchor - padding) + length)
    start = F.greatest(F.lit(0), end - length)
    gap = F.call_function("locate", F.lit(" "), flat, start + 1) - 1
    start2 = F.when((start > 0) & (gap >= 0) & (gap <= anchor), gap + 1).otherwise(start)
    # The last space at or before the end.
    before = F.length(F.regexp_extract(F.substring(flat, F.lit(1), end + 1), r"(?s)^(.*) ", 1))
    before = F.when(F.locate(" ", F.substring(flat, F.lit(1), end + 1)) > 0, before).otherwise(F.lit(-1))
    end2 = F.when((end < n) & (before > start2), before).otherwise(end)
    body = F.trim(F.substring(flat, start2 + 1, end2 - start2))
    around = F.concat(F.when(start2 > 0, F.lit(ELLIPSIS)).otherwise(F.lit("")), body, F.when(end2 < n, F.lit(ELLIPSIS)).otherwise(F.lit("")))
    return F.when(n <= length, flat).otherwise(around)


def segments(text: Column, term: str) -> Column:
    """array<struct<text, match>>: the text cut at the words that hold a match."""
    p = pattern(term, "full")
    one = F.array(F.struct(text.alias("text"), F.lit(False).alias("match")))
    if p is None:
        return F.when(F.length(text) > 0, one).otherwise(F.array().cast("array<struct<text:string,match:boolean>>"))
    gaps, found = F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0))
    pair = lambda g, f: F.array(F.struct(g.alias("text"), F.lit(False).alias("match")), F.struct(F.coalesce(f, F.lit("")).alias("text"), F.lit(True).alias("match")))
    return F.filter(F.flatten(F.zip_with(gaps, found, pair)), lambda s: s["text"] != "")


#: What counts as a word where positions of tokens are told.
_WORD = r"[\p{L}0-9_'-]+"


def match_positions(index, hits: DataFrame, term: str, props: list[str], tolerance: int = 0, key: str = "seq") -> DataFrame:
    """key, prop, token, start, length: the tokens of hits that a query word matches.

    hits is a page of results; words are found and cut where the texts are.
    """
    tokens = list(dict.fromkeys(index.analyzer.tokens(term)))
    out = None
    for prop in props:
        text = F.coalesce(F.col(prop), F.lit(""))
        found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
        rows = hits.select(key, F.split(text, _WORD, -1).alias("gaps"), found.alias("found"))
        rows = rows.select(key, F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("found")).alias("g"), F.col("found").alias("f"))).alias("k", "x"))
        from pyspark.sql import Window

        end = F.sum(F.length("x.g") + F.length("x.f")).over(Window.partitionBy(key).orderBy("k"))
        rows = rows.select(key, (end - F.length("x.f")).cast("int").alias("start"), F.col("x.f").alias("f"))
        rows = rows.select(key, F.lit(prop).alias("prop"), F.explode(index.analyzer.words(F.col("f"), prop)).alias("token"), "start", F.length("f").alias("length"))
        hit = F.lit(False)
        for t in tokens:
            near = F.col("token").startswith(t)
            hit = hit | (near | (F.levenshtein("token", F.lit(t), tolerance) >= 0) if tolerance else near)
        part = rows.where(hit).select(key, "prop", "token", "start", "length")
        out = part if out is None else out.unionAll(part)
    return out
