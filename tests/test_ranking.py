from __future__ import annotations

import random

import pytest

from sparkseek.errors import SeekError
from sparkseek.functions.scoring import Bm25
from sparkseek.functions.text import Analyzer
from sparkseek.operators.bm25 import TextQuery, ranked
from sparkseek.operators.suggest import suggest
from sparkseek.plans.search import search
from sparkseek.sources.index import Index

from . import naive

WORDS = "red reed ring rings bolt bolts colt blue blues blur".split()


def index_of(spark, rows: list[dict], schema: dict, **how) -> Index:
    columns = ["seq", *{k: None for r in rows for k in r if k != "seq"}]
    kinds = {"string": "string", "number": "double", "boolean": "boolean", "string[]": "array<string>", "enum": "string", "enum[]": "array<string>", "number[]": "array<double>"}
    ddl = ", ".join(f"`{c}` {'long' if c == 'seq' else kinds[schema[c]]}" for c in columns)
    df = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ddl)
    return Index.build(df, schema, **how)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    return [{"seq": i, "title": text(4) if rng.random() < 0.7 else None, "body": text(12)} for i in range(1, 61)]


@pytest.fixture(scope="module")
def index(spark, corpus):
    return index_of(spark, corpus, {"title": "string", "body": "string"})


CASES = [
    {"term": "red"},
    {"term": "r"},
    {"term": "red bolt", "prefix": False},
    {"term": "red bolt", "threshold": 0.0, "prefix": False},
    {"term": "re bl", "threshold": 0.0},
    {"term": "red ring blue", "threshold": 0.5, "prefix": False},
    {"term": "ri bo", "threshold": 0.3},
    {"term": "bolt", "tolerance": 1},
    {"term": "blue ring", "tolerance": 2, "threshold": 0.4},
    {"term": "blue", "exact": True},
    {"term": "blues red", "boost": {"title": 2.5}},
    {"term": ""},
    {"term": "blues", "relevance": Bm25(2.0, 0.1, 0.9)},
    {"term": "nothing"},
]


@pytest.mark.parametrize("case", CASES, ids=str)
@pytest.mark.parametrize("some", [False, True])
def test_scores_are_those_of_plain_loops(index, corpus, spark, case, some):
    from pyspark.sql import functions as F

    allowed = {x["seq"] for x in corpus if x["seq"] % 3} if some else None
    q = TextQuery(**({"properties": ["title", "body"]} | case))
    got = {r["seq"]: r["score"] for r in ranked(index, q, index.docs.where(F.col("seq") % 3 != 0) if some else None).collect()}
    how = {k: v for k, v in case.items() if k != "relevance"}
    if "relevance" in case:
        how |= {"k": case["relevance"].k, "b": case["relevance"].b, "d": case["relevance"].d}
    want = naive.scores(corpus, ["title", "body"], Analyzer().tokens, allowed=allowed, **how)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, abs(want[s])) for s in want)


def test_counts_of_terms_stay_raw(spark):
    rows = [{"seq": 1, "text": "apple apple apple pear fig"}, {"seq": 2, "text": "apple pear fig"}, {"seq": 3, "text": "fig fig pear"}]
    ix = index_of(spark, rows, {"text": "string"})
    assert {(r["seq"], r["tf"], r["len"]) for r in ix.postings.where("term = 'apple'").collect()} == {(1, 3, 5), (2, 1, 3)}
    assert ix.averages["text"] == pytest.approx(11 / 3)


def test_threshold_needs_every_word_in_one_field(spark):
    titles = ["blue jeans slim fit", "blue jeans regular fit", "slim blue shirt", "red shirt", "jeans"]
    ix = index_of(spark, [{"seq": i, "title": t} for i, t in enumerate(titles, 1)], {"title": "string"})
    count = lambda term, t: search(ix, term=term, threshold=t, properties=["title"]).count.first()[0]
    assert [count("slim fit", 0), count("blue jeans", 0), count("slim blue", 0), count("slim fit blue", 0)] == [1, 2, 2, 1]
    two = index_of(spark, [{"seq": 1, "title": "slim", "text": "fit"}, {"seq": 2, "title": "slim fit", "text": "x"}], {"title": "string", "text": "string"})
    assert [h["seq"] for h in search(two, term="slim fit", threshold=0).hits.collect()] == [2]


def test_arrays_score_as_one_field(spark):
    ix = index_of(spark, [{"seq": 1, "tags": ["red bolt", "red"]}, {"seq": 2, "tags": []}, {"seq": 3, "tags": None}], {"tags": "string[]"})
    assert [(r["term"], r["tf"], r["len"]) for r in ix.postings.orderBy("term").collect()] == [("bolt", 1, 3), ("red", 2, 3)]


def test_ties_go_by_insertion(spark):
    ix = index_of(spark, [{"seq": i, "text": "same words"} for i in range(1, 15)], {"text": "string"})
    assert [h["seq"] for h in search(ix, term="same", limit=3, offset=4).hits.collect()] == [5, 6, 7]


def test_exact_is_case_sensitive_on_the_stored_text(spark):
    ix = index_of(spark, [{"seq": 1, "text": "First Note"}, {"seq": 2, "text": "first note"}, {"seq": 3, "text": "First Notes"}], {"text": "string"})
    assert [h["seq"] for h in search(ix, term="First", exact=True).hits.collect()] == [1, 3]
    assert [h["seq"] for h in search(ix, term="Note", exact=True).hits.collect()] == [1]


def test_errors_have_their_codes(index):
    for code, how in [
        ("UNKNOWN_INDEX", {"term": "x", "properties": ["none"]}), ("INVALID_BOOST_VALUE", {"term": "x", "boost": {"title": 0}}),
        ("INVALID_SEARCH_MODE", {"mode": "other"}), ("UNKNOWN_FILTER_PROPERTY", {"where": {"none": {"eq": 1}}}), ("INVALID_VECTOR_INPUT", {"mode": "vector"}),
    ]:
        with pytest.raises(SeekError) as e:
            search(index, **how).hits.collect()
        assert e.value.code == code


def test_suggestions(spark):
    rows = ["Noise cancelling headphones", "Noise cancelling earbuds", "Noiseless fan", "Head lamp"]
    ix = index_of(spark, [{"seq": i, "title": t} for i, t in enumerate(rows, 1)], {"title": "string"})
    said = lambda *a, **k: [r["suggestion"] for r in suggest(ix, *a, **k).collect()]
    assert set(said("head")) == {"head", "headphones"}
    assert set(said("noi")) == {"noise", "noiseless"}
    assert said("noise can") == ["noise cancelling"]
    assert said("noise can noise") == ["cancelling noise"]
    assert said("zzz") == [] and said("") == []
    assert said("lamp noise", threshold=1)[0:1] != []


def test_a_suggestion_prefers_the_smaller_of_two_equal_words(spark):
    ix = index_of(spark, [{"seq": 1, "title": "abc ab x"}], {"title": "string"})
    assert [r["suggestion"] for r in suggest(ix, "a x").collect()] == ["ab x"]


def test_a_missing_field_leaves_the_running_mean(spark, corpus):
    ix = index_of(spark, corpus, {"title": "string", "body": "string"})
    words = Analyzer().tokens
    want = naive.running_mean([None if x["title"] is None else len(words(x["title"])) for x in corpus])
    assert ix.averages["title"] == pytest.approx(want, rel=1e-12)


def test_empty_collection(spark):
    ix = Index.build(spark.createDataFrame([], "seq long, text string"), {"text": "string"})
    r = search(ix, term="x", facets={"text": {}})
    assert r.count.first()[0] == 0 and r.hits.count() == 0 and r.facets["text"].count() == 0


def test_postings_and_dictionary_need_no_shuffle_of_words(spark):
    """Stemmed or not, a document's words are counted in its row; nothing runs before it is asked for."""
    from sparkseek.functions.text import Analyzer

    text = "Heations heation ouening heation " + " ".join(f"w{i % 7}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "an' -- 'x'")], "seq long, text string")
    for analyzer in (Analyzer(), Analyzer(stemming=True), Analyzer(stemming=True, allow_duplicates=False), Analyzer(stemming=True, stemmer=lambda w: "" if w == "x" else w[:2])):
        postings = Index.build(docs, {"text": "string"}, analyzer, cache=False).postings
        assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
        want = set()
        for seq, t in ((1, text), (4, "an' -- 'x'")):
            words = Analyzer().tokens(t)
            stem = analyzer.stems("text")
            kept = [s for s in map(stem, words) if s] if stem else words
            kept = kept if analyzer.allow_duplicates else list(dict.fromkeys(kept))
            want |= {(w, seq, kept.count(w), len(words) if analyzer.allow_duplicates else len(kept)) for w in kept}
        assert {tuple(r) for r in postings.select("term", "seq", "tf", "len").collect()} == want


def test_a_search_does_not_shuffle_postings_to_find_its_words(spark):
    docs = spark.createDataFrame([(i, f"hean w{i}") for i in range(1, 30)], "seq long, text string")
    ix = Index.build(docs, {"text": "string"})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = ranked(ix, TextQuery("hean w"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_the_mean_length_with_gaps_is_one_pass(spark):
    """60,000 documents were summed to the end for each of them."""
    import math
    import time

    n = 60_000
    docs = spark.range(1, n + 1).selectExpr("id AS seq", "CASE WHEN id % 3 > 0 THEN concat('a b c', if(id % 2 = 0, ' d', '')) END AS text")
    ix = Index.build(docs, {"text": "string"}, cache=False)
    began = time.time()
    got = ix.averages["text"]
    assert time.time() - began < 30
    mean = 0.0
    for i in range(1, n + 1):
        if i % 3:
            mean = (mean * (i - 1) + (4 if i % 2 == 0 else 3)) / i
    assert math.isclose(got, mean, rel_tol=1e-9)
