"""Queries of what is made of a ranked list: facets, groups, order, pins, pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import highlight as H
from ..operators import results as R
from ..plans.search import search
from .base import DOCS_SQL, PARTS_SQL, documents, events_sql, index_sql, parts, scored, scores_sql, text_sql, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TEXT = {"text": words_sql("text")}
#: The ranked list that most of these queries start from.
_LIST = {"term": "hean und", "properties": ["text"], "prefix": False}
_SC = f"{index_sql(TEXT)}, {events_sql(['hean', 'und'], ['text'], 'exact')}, {scores_sql(2)}, m AS (SELECT docs.*, score FROM sc JOIN docs USING (seq))"


def _of_list(name: str, sql: str, make) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(documents(spark, sf_dir))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, f"WITH {_SC} {sql}"


_of_list("facet_lang", "SELECT coalesce(lang, '') AS value, count(*) AS count FROM m GROUP BY 1", lambda ix: search(ix, **_LIST, facets={"lang": {}}).facets["lang"])
_of_list("facet_source_page", "SELECT source AS value, count(*) AS count FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5 OFFSET 2", lambda ix: search(ix, **_LIST, facets={"source": {"limit": 5, "offset": 2}}).facets["source"])
_of_list("facet_source_asc", "SELECT source AS value, count(*) AS count FROM m GROUP BY 1 ORDER BY 2, 1 LIMIT 10", lambda ix: search(ix, **_LIST, facets={"source": {"sort": "asc"}}).facets["source"])
_of_list("facet_source_size", "SELECT count(DISTINCT source) AS count FROM m", lambda ix: R.facet_size(ix, search(ix, **_LIST).matches, "source"))
_RANGES = [{"from": 0, "to": 500}, {"from": 400, "to": 2000}, {"from": 2000, "to": 9000}, {"from": 1_000_000, "to": 2_000_000}]
_of_list(
    "facet_nchars_ranges",
    " UNION ALL ".join(f"SELECT '{r['from']}-{r['to']}' AS value, count(*) FILTER (n_chars BETWEEN {r['from']} AND {r['to']}) AS count FROM m" for r in _RANGES),
    lambda ix: search(ix, **_LIST, facets={"n_chars": {"ranges": _RANGES}}).facets["n_chars"],
)
_GROUPED = "WITH {sc}, r AS (SELECT *, round(score, 9) AS s, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, seq) AS n FROM m)"


def _grouped(rows: DataFrame) -> DataFrame:
    """Text of a group's values and of its results, so that rows compare simply."""
    return rows.select(F.array_join("values", "|").alias("values"), F.array_join(F.transform("result", lambda x: x.cast("string")), ",").alias("result"))


_of_list(
    "group_source_top3",
    ", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, seq) AS n FROM m) SELECT source AS values, string_agg(seq::VARCHAR, ',' ORDER BY n) AS result FROM r WHERE n <= 3 GROUP BY source",
    lambda ix: _grouped(search(ix, **_LIST, group_by={"properties": ["source"], "max_result": 3}).groups),
)
_of_list(
    "group_two_properties",
    ", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, seq) AS a, row_number() OVER (PARTITION BY n_chars ORDER BY round(score, 9) DESC, seq) AS b FROM m) "
    "SELECT source || '|' || n_chars AS values, string_agg(seq::VARCHAR, ',' ORDER BY round(score, 9) DESC, seq) AS result FROM r WHERE a <= 20 AND b <= 20 GROUP BY source, n_chars",
    lambda ix: _grouped(search(ix, **_LIST, group_by={"properties": ["source", "n_chars"], "max_result": 20}).groups),
)
_of_list(
    "distinct_source",
    ", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, seq) AS n FROM m) SELECT doc_id, source, round(score, 6) AS score FROM r WHERE n = 1 ORDER BY round(score, 9) DESC, seq LIMIT 10",
    lambda ix: scored(search(ix, **_LIST, distinct_on="source").hits, "doc_id", "source"),
)
_of_list(
    "sort_nchars_desc", "SELECT doc_id, n_chars, round(score, 6) AS score FROM m ORDER BY n_chars DESC, seq DESC LIMIT 25", lambda ix: scored(search(ix, **_LIST, sort_by={"property": "n_chars", "order": "DESC"}, limit=25).hits, "doc_id", "n_chars")
)
_of_list("sort_source_collated", "SELECT doc_id, source, round(score, 6) AS score FROM m ORDER BY source, seq LIMIT 25", lambda ix: scored(search(ix, **_LIST, sort_by={"property": "source"}, limit=25).hits, "doc_id", "source"))
_of_list(
    "sort_by_keys",
    "SELECT doc_id, round(score, 6) AS score FROM m ORDER BY n_chars % 7, length(source) DESC, round(score, 9) DESC, seq LIMIT 25",
    lambda ix: scored(search(ix, **_LIST, sort_by=[F.asc(F.col("n_chars") % 7), F.desc(F.length("source"))], limit=25).hits, "doc_id"),
)

_PINS = {
    "one": {"conditions": [{"anchoring": "is", "pattern": "Hean und"}], "promote": [{"doc_id": "3", "position": 1}, {"doc_id": "900000", "position": 2}, {"doc_id": "8", "position": 4}]},
    "two": {"conditions": [{"anchoring": "starts_with", "pattern": "hean"}, {"anchoring": "contains", "pattern": "und"}], "promote": [{"doc_id": "5", "position": 1}, {"doc_id": "8", "position": 5}, {"doc_id": "11", "position": 0}]},
    "other": {"conditions": [{"anchoring": "is", "pattern": "something else"}], "promote": [{"doc_id": "1", "position": 3}]},
}
_of_list(
    "pin_rules",
    """, p AS (SELECT v.pos, docs.*, CASE WHEN sc.seq IS NULL THEN 0.0 ELSE 1000000.0 - v.pos END AS score FROM (VALUES (1, 3), (4, 8), (0, 11)) v(pos, s) JOIN docs ON docs.seq = v.s LEFT JOIN sc ON sc.seq = v.s),
f AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, seq) - 1 AS k FROM m WHERE seq NOT IN (SELECT seq FROM p)),
slots AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS k FROM (SELECT unnest(range(0, (SELECT count(*) FROM f) + 3)) AS slot) WHERE slot NOT IN (SELECT pos FROM p)),
o AS (SELECT slot, doc_id, score FROM f JOIN slots USING (k) UNION ALL SELECT pos, doc_id, score FROM p)
SELECT doc_id, round(score, 6) AS score FROM o ORDER BY slot LIMIT 15""",
    lambda ix: scored(search(replace(ix, pins=_PINS), **_LIST, limit=15).hits, "doc_id"),
)


def facet_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of an array counts once a document."""
    ix = parts(spark, sf_dir)
    return R.facet(ix, ix.docs, "words")


QUERIES["facet_array"], ORACLES["facet_array"] = facet_array, f"WITH {PARTS_SQL} SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(words)) AS value FROM docs) GROUP BY value"


def facet_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = parts(spark, sf_dir)
    return R.facet(ix, ix.docs, "large")


QUERIES["facet_boolean"], ORACLES["facet_boolean"] = facet_boolean, f"WITH {PARTS_SQL} SELECT large::VARCHAR AS value, count(*) AS count FROM docs GROUP BY 1"


def facet_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = parts(spark, sf_dir)
    return R.facet(ix, ix.docs, "sizes", {"ranges": [{"from": 0, "to": 20}, {"from": 20, "to": 60}, {"from": 0, "to": 20}]})


QUERIES["facet_array_ranges"] = facet_array_ranges
_in = "count(*) FILTER (len(list_filter(sizes, lambda x: x BETWEEN {0} AND {1})) > 0)"
ORACLES["facet_array_ranges"] = f"WITH {PARTS_SQL} SELECT '0-20' AS value, {_in.format(0, 20)} AS count FROM docs UNION ALL SELECT '20-60', {_in.format(20, 60)} FROM docs"


def facet_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each property's counts with its own choice lifted, in one scan."""
    ix = parts(spark, sf_dir)
    return R.disjunctive_facets(ix, ix.docs, {"p_brand": ["Brand#3", "Brand#5"], "p_type": ["ECONOMY"]}, ["p_brand", "p_type", "large"])


QUERIES["facet_disjunctive"] = facet_disjunctive
ORACLES["facet_disjunctive"] = f"""WITH {PARTS_SQL}, d AS (SELECT *, p_brand IN ('Brand#3', 'Brand#5') AS a, p_type = 'ECONOMY' AS b FROM docs)
SELECT 'p_brand' AS prop, p_brand AS value, count(*) AS count FROM d WHERE b GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM d WHERE a GROUP BY 2 UNION ALL SELECT 'large', large::VARCHAR, count(*) FROM d WHERE a AND b GROUP BY 2"""


def facet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of parts of a collection, summed."""
    ix = documents(spark, sf_dir)
    return R.merge_facets([R.facet(ix, ix.docs.where(F.col("lang") == k), "source", {"limit": 1_000_000}) for k in ("en", "fr", "de")])


QUERIES["facet_merge"], ORACLES["facet_merge"] = facet_merge, "SELECT source AS value, count(*) AS count FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY source"


def group_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's reducer over each group's rows in rank order."""
    import pandas as pd

    def reducer(key, frame):
        return pd.DataFrame({"source": [key[0]], "n": [len(frame)], "best": [int(frame["seq"].iloc[0])], "chars": [int(frame["n_chars"].sum())]})

    ix = documents(spark, sf_dir)
    hits = search(ix, **_LIST).matches.select("source", "seq", F.round("score", 9).alias("score"), "n_chars")
    return R.reduce_groups(ix, hits, ["source"], reducer, "source string, n long, best long, chars long")


QUERIES["group_reduced"] = group_reduced
ORACLES["group_reduced"] = f"WITH {_SC}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, seq) AS k FROM m) SELECT source, count(*) AS n, max(seq) FILTER (k = 1) AS best, sum(n_chars)::BIGINT AS chars FROM r GROUP BY source"


def group_hits_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one page (its URL without the fragment) under the page."""
    from .base import table

    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1).alias("seq"), F.regexp_replace("url", r"\?.*$", "").alias("url"), (F.length("html") % 13).cast("double").alias("score"))
    pages = pages.withColumn("url", F.concat(F.regexp_extract("url", "^([^:]+://[^/]+)", 1), F.lit("/#"), F.col("seq").cast("string")))
    return R.group_by_page(pages).select("page", F.array_join(F.transform("result", lambda x: x.cast("string")), ",").alias("result"))


QUERIES["group_hits_by_page"] = group_hits_by_page
ORACLES["group_hits_by_page"] = "SELECT regexp_extract(url, '^([^:]+://[^/]+)', 1) || '/' AS page, string_agg((page_id + 1)::VARCHAR, ',' ORDER BY length(html) % 13 DESC, page_id) AS result FROM pages GROUP BY 1"

# -- highlights ----------------------------------------------------------------------------


def highlight_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = documents(spark, sf_dir)
    hits = search(ix, **_LIST, limit=50).hits
    return hits.select("doc_id", F.md5(H.marked(F.col("text"), "hean und")).alias("partial"), F.md5(H.marked(F.col("text"), "hean und", "whole")).alias("whole"), F.md5(H.marked(F.col("text"), "hean und", "full", tag="b", css="x")).alias("full"))


QUERIES["highlight_marks"] = highlight_marks
_mark = "md5(regexp_replace(text, '{0}', '<{1} class=\"{2}\">\\0</{1}>', 'gi'))"
ORACLES["highlight_marks"] = (
    f"WITH {_SC} SELECT doc_id, {_mark.format('hean|und', 'mark', 'sparkseek-highlight')} AS partial, "
    rf"{_mark.format(r'\b(?:hean|und)\b', 'mark', 'sparkseek-highlight')} AS whole, " + _mark.format(r"\b[^\s]*(hean|und)[^\s]*\b", "b", "x") + " AS full FROM m ORDER BY round(score, 9) DESC, seq LIMIT 50"
)


def highlight_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start and (inclusive) end of each match in the page's texts."""
    hits = search(documents(spark, sf_dir), **_LIST, limit=20).hits
    return hits.select("doc_id", F.posexplode(H.positions(F.col("text"), "hean und", "whole")).alias("k", "p")).select("doc_id", "k", "p.start", "p.end")


QUERIES["highlight_positions"] = highlight_positions
_gap = r"'(?i)\b(?:hean|und)\b'"
ORACLES["highlight_positions"] = rf"""WITH {_SC}, h AS (SELECT doc_id, text FROM m ORDER BY round(score, 9) DESC, seq LIMIT 20),
s AS (SELECT doc_id, regexp_split_to_array(text, {_gap}) AS gaps, regexp_extract_all(text, {_gap}) AS found FROM h),
u AS (SELECT doc_id, unnest(found) AS f, unnest(gaps[:len(found)]) AS g, generate_subscripts(found, 1) AS k FROM s)
SELECT doc_id, (k - 1)::INTEGER AS k, (e - length(f))::INTEGER AS start, (e - 1)::INTEGER AS "end" FROM (SELECT *, sum(length(g) + length(f)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM u)"""


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(documents(spark, sf_dir), **_LIST, limit=50).hits
    return hits.select("doc_id", H.snippet(F.col("text"), "hean und").alias("snippet"), H.trimmed(F.col("text"), "hean und", 60).alias("trimmed"))


QUERIES["snippets"] = snippets


def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, start, length of each word of the page that starts with a query word."""
    hits = search(documents(spark, sf_dir), term="hean", properties=["text"], limit=10).hits
    return H.match_positions(documents(spark, sf_dir), hits, "hean", ["text"], key="doc_id")


QUERIES["match_positions"] = match_positions
ORACLES["match_positions"] = text_sql(["hean"]).replace("SELECT doc_id, round(score, 6) AS score FROM sc JOIN docs USING (seq)", ", h AS (SELECT doc_id, text FROM sc JOIN docs USING (seq)", 1) + rf"""),
s AS (SELECT doc_id, regexp_split_to_array(text, '[\p{{L}}0-9_''-]+') AS gaps, regexp_extract_all(text, '[\p{{L}}0-9_''-]+') AS found FROM h),
u AS (SELECT doc_id, unnest(found) AS f, unnest(gaps[:len(found)]) AS g, generate_subscripts(found, 1) AS k FROM s),
e AS (SELECT *, (sum(length(g) + length(f)) OVER (PARTITION BY doc_id ORDER BY k) - length(f))::INTEGER AS start FROM u),
t AS (SELECT doc_id, start, length(f)::INTEGER AS length, unnest({words_sql('f')}) AS token FROM e)
SELECT doc_id, 'text' AS prop, token, start, length FROM t WHERE starts_with(token, 'hean')"""
