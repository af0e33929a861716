"""HTML text, revisits, placement, token counts, packing, quality, fingerprints."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import fingerprint, html_text, packing, placement, quality, token_counts, warc

# -- HTML ----------------------------------------------------------------------------------

PAGES = [
    ("<p>One<p>Two <b>bold</b>", "One\n\nTwo bold"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>Al<td>12<tr><td>Barbara<td>7</table>", "Name     N\nAl       12\nBarbara  7"),
    ("<head><title>t</title></head><script>x()</script><style>p{}</style>text<noscript>no</noscript>", "text"),
    ("<div hidden>no</div><p style='display:none'>no</p><p style='visibility:hidden'>no<span style='visibility:visible'>yes</span></p>", "yes"),
    ("a<br>b<hr>c", "a\nb\nc"),
    ("<pre>\n  two\n   three </pre>", "  two\n   three "),
    ("&lt;tag&gt; &amp; &eacute;&nbsp;x", "<tag> & é\xa0x"),
    ("<div>a</div>b<section>c</section>", "a\nb\nc"),
    ("text <!-- <p>no</p> --> more", "text more"),
    ("", ""),
    ("plain 1 < 2 text", "plain 1 < 2 text"),
    ("cut <a href='x", "cut"),
    ("</p></div>stray", "stray"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_layout(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  b  c\n   d  e\nf  g  h"),
        ("<table><tr><td rowspan=0 colspan=2>a<td>b<tr><td>c<tr><td>d</table>", "a    b\n     c\n     d"),
        ("<p>x <textarea>y <b>z</textarea>", "x y <b>z"),
        ("<p>x <select><option>a<option selected>b<option>c</select> y", "x b y"),
        ("<p>x <select><option>a<option>b</select>", "x a"),
        ("<p><svg><title>t</title><text>label</text></svg> <math><mi>x</mi><mo>+</mo><mn>1</mn></math>", "label x+1"),
        ("<table><tr><td>" * 22 + "a<td>b<tr><td>c" + "</table>" * 22, "a b c"),
    ],
)
def test_forms_formulas_and_spans(page, want):
    assert html_text.extract(page) == want


def test_pages(spark):
    deep = "<div>" * 20_000 + "deep"
    tables = "<table><tr><td>" * 400 + "in"
    df = spark.createDataFrame([(1, "u", None, "z"), (2, "u", "<p>x", "z"), (2, "u", "<p>x", "z"), (None, None, deep, "z"), (4, "u", tables, "z")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_text.html_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (2, "x"), (2, "x"), (None, "deep"), (4, "in")], key=str)
    assert html_text.html_text(df.where("false")).count() == 0


# -- revisits ------------------------------------------------------------------------------

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, full string, u string, range string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com/p/?b=2&a=1&utm_x=3#f", 10, "response", '"v1"', None, {"date": "d1", "server": "s", "etag": '"v1"'}),
        (2, "https://a.com:443/p?a=1&b=2", 20, "response", 'W/"v2"', "m", {"date": "d2", "server": "s2"}),
        (3, "a.com/p?a=1&b=2", 20, "response", '"v3"', None, {"date": "d3"}),
        (4, "http://a.com/p?b=2&a=1", 15, "revisit", 'W/"v1"', None, {"date": "new", "server": "no", "expires": "e"}),
        (5, "http://a.com/p?b=2&a=1", 20, "revisit", '"v1"', None, {"date": "new"}),
        (6, "http://a.com/p?b=2&a=1", 30, "revisit", '"other"', None, None),
        (7, "http://a.com/p?b=2&a=1", 31, "revisit", None, "m", {}),
        (8, "http://a.com/p?b=2&a=1", 10, "revisit", None, None, {}),
        (9, None, 40, "revisit", None, None, {}),
        (10, "http://a.com/q", None, "revisit", None, None, {}),
        (11, "http://a.com/other", 50, "request", None, None, {}),
        (4, "http://a.com/p?b=2&a=1", 15, "revisit", 'W/"v1"', None, {"date": "new", "server": "no", "expires": "e"}),
    ]
    got = sorted(((r["record_id"], r["response_id"], r["status"]) for r in warc.resolve_revisits(records(spark, rows)).collect()), key=str)
    assert got == sorted(
        [(4, 1, "resolved"), (4, 1, "resolved"), (5, 1, "resolved"), (6, 3, "mismatch"), (7, 3, "unverified"), (8, None, "no_response"), (9, None, "no_response"), (10, None, "no_response")], key=str
    )
    four = warc.resolve_revisits(records(spark, rows)).where("record_id = 4").first()
    assert four["headers"] == {"date": "new", "server": "s", "etag": '"v1"', "expires": "e"}
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_one_url_over_many_ranges(spark):
    rows = [(i, "a.com/x" if i % 3 else f"a.com/{i}", i, "revisit" if i % 2 else "response", '"t"', None, {}) for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(records(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    last: dict = {}
    for i, u, *_ in rows:
        if i % 2:
            assert got[i] == last.get(u)
        else:
            last[u] = i


# -- placement -----------------------------------------------------------------------------


def test_lookup_table():
    names = tuple(f"s{i}" for i in range(7))
    t = placement.lookup_table(names, 1009)
    share = Counter(t)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = placement.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    for bad in (((), 7), (names, 1000), (("a", "a"), 7), (names, 5)):
        with pytest.raises(ValueError):
            placement.lookup_table(*bad)


def test_placement(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, slot string")
    out = placement.place(df, "k", ("a", "b"), 101).collect()
    assert len(out) == 3 and len({r["shard"] for r in out if r["k"] == 1}) == 1 and all(0 <= r["slot"] < 101 for r in out)
    assert placement.place(df.where("false"), "k").count() == 0


# -- tokens --------------------------------------------------------------------------------

TEXTS = ["", " ", "  ", "hello world", " lead", "trail ", "a  b   c", "▁mark ▁▁ x", "<s> </s> <unk>", "été naïve ß", "日本語 text", "😀 \U0001f9d1‍\U0001f4bb", "tab\tnew\nline\r\n", "x" * 3000, "á é", "word " * 2000, "\x00 \x07"]


def test_token_counts(documents):
    import sentencepiece

    path = token_counts.tokenizer_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "hello world")]
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(documents(docs)).collect()}
    want = {(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in docs}
    assert got == want
    assert token_counts.token_counts(documents([])).count() == 0


def test_the_first_tier_does_not_change_a_count(documents, prose):
    docs = [(i, prose.text(80) + " rareword" + str(i)) for i in range(30)]
    one, two = (sorted(map(tuple, token_counts.token_counts(documents(docs), sample_docs=n).collect())) for n in (1, 1000))
    assert one == two


# -- packing -------------------------------------------------------------------------------


def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_files()["json_path"])
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, docs, most, ids_of, capacity=None):
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in docs:
        ids = ids_of(text)
        mine = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        at = 0
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert all(r["length"] == most for r in mine[1:]) and (len(ids) > most or len(mine) == 1)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= most
    return bins


def test_packing(documents, prose):
    texts = [prose.text(prose.rng.choice([1, 5, 40, 150, 700])) for _ in range(120)] + ["", None, "<|endoftext|> x", "日本語 " * 50, "été ß 😀", "don't  stop\n\n\t x"]
    docs = list(enumerate(texts))
    out = packing.pack(documents(docs), 256, **packing.tokenizer_files()).collect()
    bins = check_packing(out, docs, 256, reference_ids())
    total = sum(r["length"] for r in out)
    assert len(bins) <= math.ceil(total / 256) * 1.1 + 1
    assert packing.pack(documents([]), 256, **packing.tokenizer_files()).count() == 0


def test_packing_keeps_every_bound(documents, prose):
    docs = [(i, prose.text(prose.rng.randrange(1, 60))) for i in range(80)]
    for select in ("norm", "dot"):
        out = packing.pack(documents(docs), 256, documents=3, attention=9_000.0, select=select, group=16, **packing.tokenizer_files()).collect()
        for own in check_packing(out, docs, 256, reference_ids()).values():
            assert len(own) <= 3 and (len(own) == 1 or sum(r["length"] ** 2 for r in own) <= 9_000)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1]), (4, 4, 4), select="other")


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_pieces_go_to_the_bins_of_plain_best_fit(prose, select):
    rng = np.random.default_rng(11)
    lengths = np.sort(rng.choice([1, 2, 3, 5, 8, 13, 40, 90], 300))[::-1]
    cap, weights = (100.0, 4.0, 3_250.0), packing.WEIGHTS
    where, offsets = packing.best_fit(lengths, cap, weights, select)
    bins, want = [], []
    for n in lengths.tolist():
        need = (n, 1, n * n)
        best = None
        # Ties go to the bin opened first.
        for k, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need, strict=True)):
                rest = [x - y for x, y in zip(left, need, strict=True)]
                if select == "norm":
                    score = sum(w * (r / c) ** 2 for w, r, c in zip(weights, rest, cap, strict=True))
                else:
                    score = -sum(w * (x / c) * (y / c) for w, x, y, c in zip(weights, left, need, cap, strict=True))
                if best is None or score < best[0] - 1e-12:
                    best = (score, k)
        k = best[1] if best else len(bins)
        if not best:
            bins.append(list(cap))
        want.append((k, cap[0] - bins[k][0]))
        bins[k] = [x - y for x, y in zip(bins[k], need, strict=True)]
    assert list(zip(where.tolist(), offsets.tolist(), strict=True)) == want
    assert any(left[0] >= 1 and left[1] < 1 for left in bins) and any(left[2] < 64 and left[0] >= 8 for left in bins)


def test_a_sequence_has_room(documents):
    with pytest.raises(ValueError):
        packing.pack(documents([(1, "x")]), 256, documents=0, **packing.tokenizer_files())


def test_the_fast_tokenizer_agrees(prose):
    ids = packing.Ids(*packing.tokenizer_files().values(), 2)
    want = reference_ids()
    for text in [*TEXTS, *(prose.text(50) for _ in range(20)), "it's we'll 12345 a_b", "x y", "ǅ ʼn Ⅷ", "  a  b  "]:
        assert ids(text).tolist() == want(text)


# -- quality -------------------------------------------------------------------------------


def grams_of(text):
    """Each code point and the end, after its context."""
    c = [None] * (quality.ORDER - 1) + list(text) + ["end"]
    return [tuple(c[i : i + quality.ORDER]) for i in range(len(text) + 1)]


def plain_model(texts, classes=quality.CLASSES):
    """Interpolated modified Kneser-Ney of code points, in loops."""
    orders = [Counter(g for t in texts for g in grams_of(t))]
    for _ in range(quality.ORDER - 1):
        orders.insert(0, Counter(g[1:] for g in orders[0]))

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[k] and n[k + 1] else k / 2
            out.append(min(max(d, 0.05), k - 0.05))
        return lambda c: min(out[min(c, 3) - 1], c)

    levels = []
    for counts in orders:
        d = discounts(counts)
        total, given = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            given[g[:-1]] += d(c)
        levels.append((counts, d, total, given))

    def p(gram):
        prob = 1 / classes
        for k, (counts, d, total, given) in enumerate(levels):
            g = gram[quality.ORDER - 1 - k :]
            ctx = g[:-1]
            if total[ctx]:
                own = (counts[g] - d(counts[g])) / total[ctx] if counts[g] else 0.0
                prob = own + given[ctx] / total[ctx] * prob
        return prob

    def perplexity(text):
        logs = [-math.log(p(g)) for g in grams_of(text)]
        return math.exp(sum(logs) / len(logs))

    return perplexity


def trained_on(spark, docs, ids):
    """Of the trusted documents, the texts that are not held out."""
    rows = spark.createDataFrame([(i, t) for i, t, *_ in docs if i in ids], "i long, text string")
    return [r["text"] for r in rows.where(~quality._held(rows)).orderBy("i").collect()]


def corpus(prose):
    good = [(i, prose.text(60), "en") for i in range(40)]
    junk = [(100 + i, "".join(prose.rng.choice("%$#@!{}~^zxq0189") for _ in range(300)), "en") for i in range(10)]
    others = [(200, None, "en"), (201, "", "en"), (202, "anything", "xx"), (203, prose.text(10), None), (204, prose.text(30), "en"), (204, prose.text(30), "en")]
    labels = [(i, 1, 0) for i in range(30)] + [(30, 1, 1), (31, 0, 0), (32, 1, 0), (32, 0, 0), (None, 1, 0), (100, 0, 1), (33, None, None)]
    return good + junk + others, labels


@pytest.mark.parametrize("hot", [0, 64, quality.HOT])
def test_perplexities_are_those_of_plain_loops(spark, documents, prose, monkeypatch, hot):
    monkeypatch.setattr(quality, "HOT", hot)
    docs, labels = corpus(prose)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.Classifier(documents(docs), table).judged().collect()
    assert len(got) == len(docs)
    want = plain_model(trained_on(spark, docs, range(30)))
    text = {i: t for i, t, _ in docs if i != 204}
    for r in got:
        if r["lang"] == "en" and text.get(r["doc_id"]):
            assert r["perplexity"] == pytest.approx(want(text[r["doc_id"]]), rel=1e-3)
        elif r["doc_id"] != 204:
            assert r["perplexity"] is None and r["kept"]
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & set(range(100, 110)) and len(kept & set(range(30))) >= 29


def test_scripts_stay_apart_and_long_texts_are_whole(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(quality, "HOT", 32)
    scripts = {"ru": "абвгдеёжзийклмнопрст ", "zh": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "ar": "ابتثجحخدذرزسشصضطظعغ ", "x😀": "😀😁😂🤣😃 "}
    docs, good = [], {}
    for k, (lang, letters) in enumerate(scripts.items()):
        good[lang] = range(k * 100, k * 100 + 25)
        docs += [(i, "".join(prose.rng.choices(letters, k=80)), lang) for i in good[lang]]
        # The same text under every language.
        docs += [(k * 100 + 50 + j, "天地 玄黄 абв 😀", lang) for j in range(2)]
    docs.append((999, "".join(prose.rng.choices(scripts["zh"], k=quality.CHUNK + 1000)), "zh"))
    labels = spark.createDataFrame([(i, 1, 0) for ids in good.values() for i in ids], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.Classifier(documents(docs), labels).judged().collect()}
    assert len(got) == len(docs)
    for lang, ids in good.items():
        want = plain_model(trained_on(spark, docs, ids))
        for i, t, own in docs:
            if own == lang:
                assert got[i]["perplexity"] == pytest.approx(want(t), rel=1e-3)


def test_more_languages_than_any_fixed_number(spark, documents, prose):
    docs = [(100 * k + i, prose.text(20), f"l{k}") for k in range(40) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in docs], "doc_id long, quality int, toxic int")
    out = quality.Classifier(documents(docs), labels)
    assert out.thresholds.count() >= 25
    assert out.judged().where("perplexity IS NULL").count() == 0


def test_accepted_documents_are_whole(spark, documents, prose):
    docs, labels = corpus(prose)
    df = documents([*docs, *[(300 + i, prose.text(40), "fr") for i in range(5)]])
    table = spark.createDataFrame([*labels, (300, 1, 0), (301, 1, 0)], "doc_id long, quality int, toxic int")
    c = quality.Classifier(df, table)
    out = c.accepted(df)
    assert out.columns == df.columns
    assert sorted([r["doc_id"] for r in out.collect()], key=str) == sorted([r["doc_id"] for r in c.judged().where("kept").collect()], key=str)


def test_without_trusted_text_all_are_kept(spark, documents):
    df = documents([(1, "x"), (2, None)])
    c = quality.Classifier(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert c.accepted(df).count() == 2 and [r["kept"] for r in c.judged().collect()] == [True, True]
    assert quality.Classifier(df.where("false"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).judged().count() == 0


def test_the_model_grows_with_the_text(spark, documents, prose):
    sizes = []
    for n in (20, 200):
        df = documents([(i, prose.text(40)) for i in range(n)])
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
        sizes.append(quality.train(quality.trusted_text(df, labels))[0].count())
    assert sizes[1] > 1.5 * sizes[0]


def test_unseen_good_text_is_not_judged_by_what_was_trained_on(spark, documents, prose):
    words = prose.words(400)
    docs = [(i, " ".join(prose.rng.choices(words, k=60)), "en") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = [r["doc_id"] for r in quality.Classifier(documents(docs), labels).judged().where("kept").collect()]
    assert len([i for i in kept if i >= 60]) >= 50


# -- fingerprints --------------------------------------------------------------------------


def test_edited_texts(documents, prose):
    docs = [(i, prose.text(30 + i)) for i in range(12)] + [(20, None), (21, ""), (22, "é😀x"), (23, "one two three"), (24, prose.text(2000))]
    rows = {r["doc_id"]: r for r in fingerprint.edited_pairs(documents(docs)).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_blocks_do_not_change_a_row(documents, prose):
    docs = [(i * 3 % 101, prose.text(20)) for i in range(101)]
    whole = sorted(map(str, fingerprint.edited_pairs(documents(docs)).collect()))
    from unittest import mock

    with mock.patch.object(fingerprint.in_blocks, "__defaults__", (10,)):
        assert sorted(map(str, fingerprint.edited_pairs(documents(docs)).collect())) == whole


def test_ties_and_single_rows(documents):
    one = fingerprint.edited_pairs(documents([(5, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    two = fingerprint.edited_pairs(documents([(5, "abc"), (5, "abc"), (None, "xyz")])).collect()
    assert len(two) == 3 and fingerprint.edited_pairs(documents([])).count() == 0


def test_sketches_estimate_and_merge(spark, prose):
    long_text = prose.text(6000)
    part = " ".join(long_text.split()[:1500])
    other = prose.text(3000)
    df = spark.createDataFrame([(long_text, part, other, "", "a b")], "l string, p string, o string, e string, s string")
    for c in df.columns:
        df = fingerprint.with_sketch(df, c, f"s_{c}")
    r = df.select(
        fingerprint.likeness(F.col("s_l"), F.col("s_l")).alias("same"), fingerprint.likeness(F.col("s_l"), F.col("s_o")).alias("far"), fingerprint.containment(F.col("s_p"), F.col("s_l")).alias("inside"),
        fingerprint.containment(F.col("s_l"), F.col("s_p")).alias("quarter"), fingerprint.likeness(F.col("s_e"), F.col("s_e")).alias("empty"), F.size("s_s").alias("short"), F.size("s_l").alias("n"),
        F.array_intersect(fingerprint.merge(F.col("s_l"), F.col("s_o")), F.col("s_o")).alias("both"), F.col("s_o"),
    ).first()
    assert r["same"] == 1.0 and r["far"] < 0.02 and r["inside"] == 1.0 and abs(r["quarter"] - 0.25) < 0.06 and r["empty"] == 1.0 and r["short"] == 1
    assert 5996 / 8 * 0.8 < r["n"] < 5996 / 8 * 1.2 and sorted(r["both"]) == sorted(r["s_o"])
