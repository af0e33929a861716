"""Full-text queries: ranking, expansion, thresholds, analysis, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import Bm25
from ..functions.text import Analyzer
from ..operators import rankers
from ..operators.suggest import suggest
from ..plans.search import search
from ..sources.index import Index
from .base import DOCS_SQL, DOCUMENTS, ORDER, PARTS_SQL, documents, events_sql, index_sql, kept, parts, scored, table, text_sql, words_sql

STOP = ("the", "of", "and", "que", "la", "le")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TEXT = {"text": words_sql("text")}


def _simple(name: str, sql: str, **request) -> None:
    """A search of documents' text, its page with scores."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(search(documents(spark, sf_dir), **({"properties": ["text"]} | request)).hits, "doc_id")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


_simple("ft_exact_word", text_sql(["thed"], mode="exact"), term="thed", prefix=False)
_simple("ft_prefix", text_sql(["heon"]), term="heon")
_simple("ft_multi_term_any", text_sql(["anon", "ouen", "the"]), term="anon ouen the")
_simple("ft_whole_words", text_sql(["the", "and", "that"], mode="exact"), term="the and that", prefix=False)
_simple("ft_threshold_zero", text_sql(["anon", "hees"], threshold=0, mode="exact"), term="anon hees", threshold=0, prefix=False)
_simple("ft_threshold_half", text_sql(["anon", "hees", "ndre"], threshold=0.5, mode="exact", limit=100), term="anon hees ndre", threshold=0.5, prefix=False, limit=100)
_simple("ft_bm25_params", text_sql(["hetion", "inhe"], k=2.0, b=0.4, d=1.0), term="hetion inhe", relevance=Bm25(2.0, 0.4, 1.0))
_simple("ft_fuzzy_1", text_sql(["hetion"], tolerance=1), term="hetion", tolerance=1)
_simple("ft_fuzzy_2_threshold", text_sql(["hetion", "reouth"], tolerance=2, threshold=0.3, limit=50), term="hetion reouth", tolerance=2, threshold=0.3, limit=50)
_simple("ft_exact_case", text_sql(["anon", "hees"], mode="exact", allowed=r"regexp_matches(text, '\bAnon\b') AND regexp_matches(text, '\bhees\b')"), term="Anon hees", exact=True)
_simple("ft_empty_term_props", text_sql([""]), term="")
_simple("ft_where_lang", text_sql(["es", "la"], allowed="lang = 'es'", mode="exact"), term="es la", prefix=False, where={"lang": {"eq": "es"}})
_simple("ft_where_nchars_between", text_sql(["hean"], allowed="n_chars BETWEEN 500 AND 3000"), term="hean", where={"n_chars": {"between": [500, 3000]}})
_simple("ft_folding", text_sql(["eque"], mode="exact"), term="Éque", prefix=False)
_simple("ft_limit_offset", text_sql(["hean", "und"], limit=7, offset=5), term="hean und", limit=7, offset=5)
_simple("ft_repeated_terms", text_sql(["hees"], mode="exact"), term="hees hees HEES", prefix=False)
_simple("browse", f"WITH {DOCS_SQL} SELECT doc_id, 0.0::DOUBLE AS score FROM docs ORDER BY seq LIMIT 10", term="", properties=None)
_simple("browse_where", f"WITH {DOCS_SQL} SELECT doc_id, 0.0::DOUBLE AS score FROM docs WHERE lang = 'de' ORDER BY seq LIMIT 25", term="", properties=None, where={"lang": {"eq": "de"}}, limit=25)


def ft_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its score, not only a page."""
    return scored(search(documents(spark, sf_dir), term="re ti", properties=["text"]).matches, "doc_id")


QUERIES["ft_all_matches"], ORACLES["ft_all_matches"] = ft_all_matches, text_sql(["re", "ti"], limit=None)


def ft_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = documents(spark, sf_dir, Analyzer(stop_words=STOP), "documents without stop words")
    return scored(search(ix, term="the hean of und", properties=["text"], prefix=False).hits, "doc_id")


QUERIES["ft_stopwords"], ORACLES["ft_stopwords"] = ft_stopwords, text_sql(["hean", "und"], mode="exact", stop=STOP)


def ft_preflight_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), term="ouen", properties=["text"], preflight=True).count


QUERIES["ft_preflight_count"], ORACLES["ft_preflight_count"] = ft_preflight_count, text_sql(["ouen"], limit=None, select="count(*) AS count")

BOOST = {"p_name": 3.0, "p_type": 0.5}
PART_PROPS = {p: words_sql(p) for p in BOOST}


def ft_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields, weighed."""
    return scored(search(parts(spark, sf_dir), term="small ring", boost=BOOST, limit=50).hits, "p_partkey")


QUERIES["ft_boost"] = ft_boost
ORACLES["ft_boost"] = text_sql(["small", "ring"], PART_PROPS, "p_partkey, round(score, 6) AS score", 50, docs=PARTS_SQL, boost=BOOST)


def ft_two_fields_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word within one field; fields that no document fulfils don't score."""
    return scored(search(parts(spark, sf_dir), term="small ring", threshold=0, limit=200).hits, "p_partkey")


QUERIES["ft_two_fields_all"] = ft_two_fields_all
ORACLES["ft_two_fields_all"] = text_sql(["small", "ring"], PART_PROPS, "p_partkey, round(score, 6) AS score", 200, docs=PARTS_SQL, threshold=0)


def ft_where_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"and": [{"words": {"containsAny": ["red", "blue"]}}, {"not": {"p_size": {"gt": 30}}}]}
    return scored(search(parts(spark, sf_dir), term="economy", properties=["p_type"], where=where, limit=30).hits, "p_partkey")


QUERIES["ft_where_tags"] = ft_where_tags
ORACLES["ft_where_tags"] = text_sql(["economy"], PART_PROPS | {}, "p_partkey, round(score, 6) AS score", 30, docs=PARTS_SQL, allowed="list_has_any(words, ['red', 'blue']) AND NOT p_size > 30").replace("d.prop IN ('p_name', 'p_type')", "d.prop IN ('p_type')")


def conversations(spark: SparkSession, sf_dir: str) -> Index:
    """A conversation is a document whose field is the array of its turns."""

    def build() -> Index:
        rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
        docs = rows.select("conv_id", (F.col("conv_id") + 1).alias("seq"), F.transform("t", lambda x: x["text"]).alias("turns"))
        return Index.build(docs, {"turns": "string[]"})

    return kept(spark, sf_dir, "conversations", build)


def ft_string_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of strings scores as one field."""
    return scored(search(conversations(spark, sf_dir), term="hean und", limit=40).hits, "conv_id")


QUERIES["ft_string_array"] = ft_string_array
ORACLES["ft_string_array"] = text_sql(
    ["hean", "und"], {"turns": words_sql("turns")}, "conv_id, round(score, 6) AS score", 40, docs="docs AS (SELECT conv_id + 1 AS seq, conv_id, string_agg(text, E' \\n ' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)"
)


def ft_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the field: the running mean length depends on their places."""

    def build() -> Index:
        d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 1).alias("seq"), F.when(F.col("lang") != "fr", F.col("text")).alias("text"))
        return Index.build(d, {"text": "string"})

    return scored(search(kept(spark, sf_dir, "documents with gaps", build), term="hean und", prefix=False).hits, "doc_id")


_gaps = "docs AS (SELECT doc_id + 1 AS seq, doc_id, CASE WHEN lang <> 'fr' THEN text END AS text FROM documents)"
_plain_average = "av AS (SELECT prop, sum(len) / (SELECT n FROM n) AS av FROM fl GROUP BY prop)"
_running_average = """av AS (SELECT 'text' AS prop, sum(len * exp(later)) / max(nn) AS av FROM (
  SELECT coalesce(len, 0) AS len, (SELECT n FROM n) AS nn, coalesce(sum(CASE WHEN text IS NULL AND docs.seq > 1 THEN ln(docs.seq / (docs.seq - 1)) ELSE 0 END) OVER (ORDER BY docs.seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later
  FROM docs LEFT JOIN fl ON fl.seq = docs.seq))"""
QUERIES["ft_missing_values"] = ft_missing_values
ORACLES["ft_missing_values"] = text_sql(["hean", "und"], mode="exact", docs=_gaps).replace(_plain_average, _running_average)


def ft_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English stems (no SQL: tests hold the stemmer against known pairs)."""
    ix = documents(spark, sf_dir, Analyzer(stemming=True), "documents stemmed")
    return scored(search(ix, term="heations ouening", properties=["text"], prefix=False).hits, "doc_id")


QUERIES["ft_stemmed"] = ft_stemmed

# -- analysis and statistics ---------------------------------------------------------------


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", Analyzer().words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


QUERIES["tokenize"] = tokenize
ORACLES["tokenize"] = f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)"


def tokenize_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", Analyzer("multilingual", allow_duplicates=False).words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join(F.slice("w", 1, 5), " ").alias("first"))


QUERIES["tokenize_multilingual"] = tokenize_multilingual
ORACLES["tokenize_multilingual"] = f"""SELECT doc_id, len(list_distinct(w))::BIGINT AS n_tokens,
  array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: (list_position(w, x), x)))[:5], lambda p: p[2]), ' ') AS first FROM (SELECT doc_id, {words_sql('text', 'multilingual')} AS w FROM documents)"""


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each word."""
    return documents(spark, sf_dir).terms.where("prop = 'text'").select("term", "df")


QUERIES["term_df"], ORACLES["term_df"] = term_df, f"WITH {index_sql(TEXT)} SELECT term, df FROM df"


def field_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = documents(spark, sf_dir)
    lengths = ix.postings.where("prop = 'text'").groupBy("seq").agg(F.max("len").alias("len"), F.sum("tf").alias("total"))
    return lengths.select((F.col("seq") - 1).alias("doc_id"), F.col("len").cast("long").alias("len"), "total", F.round(F.lit(ix.averages["text"]), 6).alias("average"))


QUERIES["field_length_stats"] = field_length_stats
ORACLES["field_length_stats"] = f"WITH {index_sql(TEXT)} SELECT seq - 1 AS doc_id, len, len AS total, round(av, 6) AS average FROM fl JOIN av USING (prop)"


def fuzzy_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words within an edit distance of one, or one of whose beginnings is the word."""
    from ..operators.expand import matches

    return documents(spark, sf_dir).terms.where("prop = 'text'").where(matches("heon", False, 1)).select("term", "df", F.levenshtein("term", F.lit("heon")).alias("distance"))


QUERIES["fuzzy_dictionary"] = fuzzy_dictionary
ORACLES["fuzzy_dictionary"] = f"WITH {index_sql(TEXT)} SELECT term, df, levenshtein(term, 'heon')::INTEGER AS distance FROM df WHERE levenshtein(term, 'heon') <= 1 OR starts_with(term, 'heon')"

# -- suggestions ---------------------------------------------------------------------------


def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(suggest(documents(spark, sf_dir), "hean", ["text"]), "suggestion", "count")


QUERIES["suggest_prefix"] = suggest_prefix
_page = "ORDER BY round(sum(w), 9) DESC, count(*) DESC, suggestion LIMIT 10"
ORACLES["suggest_prefix"] = f"WITH {index_sql(TEXT)}, {events_sql(['hean'], ['text'])} SELECT term AS suggestion, count(*) AS count, round(sum(w), 6) AS score FROM ev GROUP BY term {_page}"


def suggest_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(suggest(documents(spark, sf_dir), "heon re", ["text"]), "suggestion", "count")


QUERIES["suggest_phrase"] = suggest_phrase
ORACLES["suggest_phrase"] = f"""WITH {index_sql(TEXT)}, {events_sql(['heon', 're'], ['text'])},
b AS (SELECT * FROM (SELECT seq, term, w, row_number() OVER (PARTITION BY seq ORDER BY w DESC, term) AS r FROM ev WHERE i = 0) WHERE r = 1),
p AS (SELECT b.term || ' ' || e.term AS suggestion, b.w + e.w AS w FROM b JOIN ev e ON e.seq = b.seq AND e.i = 1)
SELECT suggestion, count(*) AS count, round(sum(w), 6) AS score FROM p GROUP BY suggestion {_page}"""


def suggest_where_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last word is completed; among documents that pass a filter."""
    from ..operators.filters import Where

    ix = documents(spark, sf_dir)
    allowed = Where(ix, {"lang": {"eq": "en"}}).apply(ix.docs).select("seq")
    return scored(suggest(ix, "the hean", ["text"], prefix="last", allowed=allowed), "suggestion", "count")


QUERIES["suggest_where_last"] = suggest_where_last
ORACLES["suggest_where_last"] = f"""WITH {index_sql(TEXT)}, {events_sql(['the', 'hean'], ['text'])}, k AS (SELECT ev.* FROM ev JOIN docs USING (seq) WHERE lang = 'en'),
p AS (SELECT b.term || ' ' || e.term AS suggestion, b.w + e.w AS w FROM k b JOIN k e ON e.seq = b.seq AND e.i = 1 WHERE b.i = 0 AND b.term = 'the')
SELECT suggestion, count(*) AS count, round(sum(w), 6) AS score FROM p GROUP BY suggestion {_page}"""

# -- other rankers -------------------------------------------------------------------------


def qps_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By occurrences and shared sentences."""
    ix = documents(spark, sf_dir)
    page = rankers.by_sentences(ix, "hean ouen", ["text"]).orderBy(F.desc(F.round("score", 9)), "seq").limit(20)
    return scored(page.withColumn("doc_id", F.col("seq") - 1), "doc_id")


QUERIES["qps_rank"] = qps_rank
ORACLES["qps_rank"] = f"""WITH {DOCS_SQL}, st AS (SELECT seq, s, list_distinct({words_sql('x')}) AS w FROM (SELECT seq, unnest(regexp_split_to_array(text, '[.?!]')) AS x, generate_subscripts(regexp_split_to_array(text, '[.?!]'), 1) AS s FROM docs)),
bt AS (SELECT seq, w, least(coalesce(sum((len(w) > 1)::INTEGER) OVER (PARTITION BY seq ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 20)::INTEGER AS bit, sum(len(w)) OVER (PARTITION BY seq) AS total FROM st),
u AS (SELECT seq, bit, total, unnest(w) AS term FROM bt),
g AS (SELECT seq, term, total, count(*) FILTER (bit < 20) AS a, count(*) FILTER (bit = 20) AS b, bit_or(CASE WHEN bit < 20 THEN 1 << bit ELSE 0 END) AS mask FROM u GROUP BY ALL),
h AS (SELECT *, CASE WHEN b = 0 THEN a ELSE (a + 1) + a % 2 + 2 * (b - 1) END AS n FROM g WHERE starts_with(term, 'hean') OR starts_with(term, 'ouen')),
r AS (SELECT seq, sum(n ** 2 / total + (term IN ('hean', 'ouen'))::INTEGER) + 2 * (sum(bit_count(mask)) - bit_count(bit_or(mask))) AS score FROM h GROUP BY seq)
SELECT seq - 1 AS doc_id, round(score, 6) AS score FROM r {ORDER} LIMIT 20"""


def pt15_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the place of words in the field."""
    ix = documents(spark, sf_dir)
    page = rankers.by_position(ix, "hean ouen", ["text"], {"text": 2}).orderBy(F.desc("score"), "seq").limit(20)
    return scored(page.withColumn("doc_id", F.col("seq") - 1), "doc_id")


QUERIES["pt15_rank"] = pt15_rank
ORACLES["pt15_rank"] = f"""WITH {DOCS_SQL}, o AS (SELECT seq, list_transform(list_sort(list_transform(list_distinct(w), lambda x: (list_position(w, x), x))), lambda p: p[2]) AS w FROM (SELECT seq, {words_sql('text')} AS w FROM docs)),
u AS (SELECT seq, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM o)
SELECT seq - 1 AS doc_id, round(sum((14 - CASE WHEN n < 15 THEN i ELSE (i * 15) // n END) * 2 * (starts_with(term, 'hean')::INTEGER + starts_with(term, 'ouen')::INTEGER)), 6)::DOUBLE AS score
FROM u WHERE starts_with(term, 'hean') OR starts_with(term, 'ouen') GROUP BY seq ORDER BY score DESC, seq LIMIT 20"""


def ft_statistics_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of English documents alone, scored by the numbers of all."""
    part = kept(spark, sf_dir, "english documents", lambda: Index.build(documents(spark, sf_dir).docs.where("lang = 'en'"), DOCUMENTS))
    found = search(part.with_statistics_of(documents(spark, sf_dir)), term="hean und", properties=["text"], prefix=False, limit=30)
    return scored(found.hits, "doc_id")


QUERIES["ft_statistics_of_all"] = ft_statistics_of_all
ORACLES["ft_statistics_of_all"] = text_sql(["hean", "und"], limit=30, mode="exact", allowed="lang = 'en'")
