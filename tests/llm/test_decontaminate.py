from __future__ import annotations

import re

import pytest

from sparkseek.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            for i in range(len(v) - k + 1 if k else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit.update(range(j, j + k))
                        found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=str)


def case(prose):
    items = [(i, prose.text(n)) for i, n in enumerate([30, 12, 10, 5, 1, 2, 14], 1)] + [(8, None), (9, ""), (None, prose.text(20)), (1, prose.text(11)), (10, "Élan VITAL 42 42 42 42 42 42 42 42 42 42 42")]
    real = [t for _, t in items[:3]]
    docs = [(i, prose.text(60)) for i in range(6)]
    docs += [(6, real[0].upper() + "!"), (7, prose.text(5) + ", " + " ".join(real[1].split()[1:11]) + " " + prose.text(5)), (8, real[2] + " " + real[2]), (9, None), (10, ""), (10, "... !!"), (11, "élan vital " + "42 " * 15), (8, real[2] + " " + real[2])]
    docs += [(None, real[0]), (12, " ".join(real[0].split()[:9])), (13, "x" * 50_000 + " " + real[1])]
    return docs, items


@pytest.mark.parametrize("block", [1 << 25, 150])
def test_hits_are_those_of_brute_force(spark, documents, prose, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = case(prose)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.contamination(documents(docs), table)).collect()
    real = [(i, t) for i, t in items if i is not None]
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got], key=str) == brute(docs, real)


def test_digest_of_the_items(spark, documents):
    import hashlib

    table = spark.createDataFrame([(2, "aa bb"), (10, "bb cc"), (3, "zz")], "item_id long, text string")
    row = D.digest(D.contamination(documents([(1, "aa bb cc")]), table)).first()
    assert row["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and row["n_hit"] == 3


@pytest.mark.parametrize("block", [1 << 25, 150])
def test_removal_keeps_whole_rows(spark, documents, prose, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs, items = case(prose)
    df = documents(docs)
    table = spark.createDataFrame(items, "item_id long, text string")
    out = D.remove_contaminated(df, table)
    assert out.columns == df.columns
    clean = [r[0] for r in brute(docs, [(i, t) for i, t in items if i is not None]) if not r[4]]
    assert sorted([r["doc_id"] for r in out.collect()], key=str) == sorted(clean, key=str)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in D.digest(D.contamination(documents([(1, "a b")]), none)).collect()] == [0]
    assert D.remove_contaminated(documents([(1, "a b")]), none).count() == 1
    assert D.contamination(documents([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
