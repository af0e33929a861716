from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.errors import SeekError
from sparkseek.functions import highlight as H
from sparkseek.functions.stemmer import stem
from sparkseek.functions.stopwords import languages, stop_words
from sparkseek.functions.text import Analyzer, collation


def column(spark, texts, analyzer):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["w"] for r in df.select("i", analyzer.words(F.col("t")).alias("w")).orderBy("i").collect()]


TEXTS = ["It's a t-shirt -- 'quoted' well-known.", "gâteau ÉCOLE Straße Łódź", "β-blockers किताब", "a_b 12.5 x--", "", None, "mañana, niño; 3×4 ÷ 2", "東京タワー", "it''s --a-- -'- b"]


@pytest.mark.parametrize("language", ["english", "french", "german", "multilingual", "vietnamese", "norwegian", "japanese"])
def test_column_and_plain_rules_agree(spark, language):
    a = Analyzer(language)
    assert column(spark, TEXTS, a) == [a.tokens(t) for t in TEXTS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAbB'-_ 1éÉßŒ,.\n\t中", max_size=24), min_size=1, max_size=20))
def test_column_and_plain_rules_agree_on_any_text(spark, texts):
    a = Analyzer("english", stop_words=("a", "b"))
    assert column(spark, texts, a) == [a.tokens(t) for t in texts]


def test_words():
    assert Analyzer().tokens("It's a t-shirt -- 'quoted' well-known.") == ["it's", "a", "t-shirt", "quoted", "well-known"]
    assert Analyzer("german").tokens("It's t-shirt") == ["it", "s", "t", "shirt"]
    assert Analyzer().tokens("gâteau Œuvre Straße Þór") == ["gateau", "ouvre", "strase", "por"]
    assert Analyzer("vietnamese").tokens("Tài khoản") == ["tài", "khoản"]
    assert Analyzer(allow_duplicates=False).tokens("b a b") == ["b", "a"]
    assert Analyzer(tokenize_skip=frozenset(["id"])).tokens("Some ID-9", "id") == ["Some ID-9"]
    assert Analyzer("japanese").tokens("東京タワー x 人") == ["東京", "京タ", "タワ", "ワー", "x", "人"]


def test_unknown_languages_and_missing_stemmers():
    for make, code in ((lambda: Analyzer("klingon"), "LANGUAGE_NOT_SUPPORTED"), (lambda: Analyzer("german", stemming=True), "MISSING_STEMMER")):
        with pytest.raises(SeekError) as e:
            make()
        assert e.value.code == code
    assert Analyzer("german", stemming=True, stemmer=lambda w: w[:3]).tokens("Häuser") == ["hau"]


def test_stems_of_the_published_examples():
    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl
    sized size hopping hop tanned tan falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit vietnamization vietnam
    triplicate triplic formative form formalize formal hopeful hope goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac
    adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll""".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want, word


def test_stop_words_are_folded():
    assert len(languages()) >= 10 and "a" in stop_words("french") and "etre" in stop_words("french") and stop_words("klingon") == ()
    assert Analyzer("french", stop_words=stop_words("french")).tokens("Être à la plage") == ["plage"]


def test_collations():
    assert collation("english") == "en" and collation("tamil") == "UNICODE"


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_marks(spark):
    text = "The quick brown Fox jumps. foxes a.b"
    mark = lambda w, **k: one(spark, text, lambda c: H.marked(c, w, css="c", **k))
    assert mark("fox") == 'The quick brown <mark class="c">Fox</mark> jumps. <mark class="c">fox</mark>es a.b'
    assert mark("fox", strategy="whole") == 'The quick brown <mark class="c">Fox</mark> jumps. foxes a.b'
    assert mark("ox", strategy="full", tag="b") == 'The quick brown <b class="c">Fox</b> jumps. <b class="c">foxes</b> a.b'
    assert mark("fox", case_sensitive=True) == 'The quick brown Fox jumps. <mark class="c">fox</mark>es a.b'
    assert mark("a.b").endswith('<mark class="c">a.b</mark>') and mark("") == text
    with pytest.raises(ValueError):
        H.pattern("x", "other")


def test_positions_and_segments(spark):
    at = one(spark, "ab cab", lambda c: H.positions(c, "ab"))
    assert [(p["start"], p["end"]) for p in at] == [(0, 1), (4, 5)]
    assert one(spark, "none", lambda c: H.positions(c, "ab")) == [] and one(spark, "none", lambda c: H.positions(c, " ")) == []
    cut = one(spark, "ab cab x", lambda c: H.segments(c, "ab"))
    assert [(s["text"], s["match"]) for s in cut] == [("ab", True), (" ", False), ("cab", True), (" x", False)]


def test_snippets(spark):
    text = " ".join(f"word{i}" for i in range(100))
    cut = one(spark, text, lambda c: H.snippet(c, "word50", 60))
    assert cut.startswith("…") and cut.endswith("…") and "word50" in cut and len(cut) <= 62
    assert all(w in text.split() for w in cut.strip("…").split())
    assert one(spark, "short  text", lambda c: H.snippet(c, "x")) == "short text"
    assert one(spark, text, lambda c: H.snippet(c, "zzz", 20)) == "word0 word1 word2…"


def test_trim(spark):
    text = "a" * 50 + " needle " + "b" * 50
    cut = one(spark, text, lambda c: H.trimmed(c, "needle", 20))
    assert cut.startswith("...") and cut.endswith("...") and '<mark class="sparkseek-highlight">needle</mark>' in cut
    assert one(spark, text, lambda c: H.trimmed(c, "zzz", 10)) == "a" * 10 + "..."
    assert one(spark, "tiny needle", lambda c: H.trimmed(c, "needle", 50)).endswith("needle</mark>")
