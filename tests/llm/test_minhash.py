from __future__ import annotations

import numpy as np
import pytest

from sparkseek.llm import minhash as M


def shingles(text, size):
    w = (text or "").lower().split()
    if not w:
        return set()
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_copies(prose):
    base = [prose.text(n) for n in (40, 120, 300, 25)]
    docs, at = [], 100
    for text in base:
        for k in range(14):
            at += 1
            docs.append((at, prose.changed(text, 0.004 * k)))
        docs += [(at + 1000, text), (at + 2000, text.upper())]
    chain = prose.words(60)
    for k in range(12):  # each is like the one before, the ends are not alike
        docs.append((5000 + k, " ".join(chain)))
        for j in range(3):
            chain[(7 * k + 19 * j) % 60] = prose.word()
    docs += [(9000 + i, prose.text(50)) for i in range(20)]
    docs += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "x " * 3000), (8, "x " * 2999), (9, "é " * 4), (None, base[0]), (None, None), (10, base[1]), (10, "other words here")]
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_brute_force(documents, prose, size):
    docs = near_copies(prose)
    got = M.near_duplicates(documents(docs), size).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute(docs, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_groups_take_the_bounded_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(M, "LEFT_BLOCK", 8)
    monkeypatch.setattr(M, "RIGHT_BLOCK", 16)
    docs = near_copies(prose)
    got = M.near_duplicates(documents(docs), 2).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute(docs, 2)


def test_first_of_each_group_stays(documents, prose):
    docs = [d for d in near_copies(prose) if d[0] not in (None, 10)]
    df = documents(docs)
    out = M.keep_first(df, 5)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _, c in brute(docs, 5) if i == c)


def test_empty_table(documents):
    assert M.near_duplicates(documents([])).count() == 0 and M.keep_first(documents([])).count() == 0
    assert [(r["component_id"], r["kept"]) for r in M.near_duplicates(documents([(3, None)])).collect()] == [(3, True)]


def test_documents_within_the_threshold_share_a_key():
    """Pigeonhole: whatever 2 * CHUNKS - 1 values differ, some key is the same."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, M.VALUES), dtype=np.uint16)
        b = a.copy()
        b[0, rng.choice(M.VALUES, 2 * M.CHUNKS - 1, replace=False)] ^= 1
        assert (M.keys_of(a) == M.keys_of(b)).any()


def test_parity_never_turns_down_an_alike_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(100):
        s = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        k = int(rng.integers(0, 60))
        t = np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        both = len(np.intersect1d(s, t))
        if 100 * both >= 80 * (len(s) + len(t) - both):
            x, y = (M.parity_of(v).view(np.uint64) for v in (s, t))
            assert M.may_be_alike(x, y, len(s), len(t), 80)


def test_recall_of_the_index_near_the_threshold():
    """Pairs 0.80 to 0.85 alike share a key, but for a few in ten thousand."""
    rng, (a, b) = np.random.default_rng(3), M._multipliers()
    missed, n = 0, 3000
    for _ in range(n):
        size = int(rng.integers(60, 400))
        both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        own = int(size * (1 / rng.uniform(0.80, 0.85) - 1))
        more = rng.integers(0, 1 << 63, own, dtype=np.uint64)
        x, y = np.concatenate([both, more[: own // 2]]), np.concatenate([both, more[own // 2 :]])
        keys = M.keys_of(np.stack([M.signature(x, a, b), M.signature(y, a, b)]))
        missed += not (keys[0] == keys[1]).any()
        assert M.may_be_alike(M.parity_of(x).view(np.uint64), M.parity_of(y).view(np.uint64), len(x), len(y), 80)
    assert missed <= 0.002 * n


def test_one_row_of_each_group_stays(documents, prose):
    base, other = prose.text(200), prose.text(200)
    docs = [(1, base), (2, base), (2, other), (3, prose.text(50)), (3, prose.text(50)), (4, other + " x"), (5, "lone text of five words here"), (5, "lone text of five words here"), (None, base), (None, base), (6, ""), (6, "")]
    out = M.keep_first(documents(docs))
    rows = sorted((str(r["doc_id"]), r["text"][:20]) for r in out.collect())
    # The unique text of id 2 stays, though its other text is a copy; so do both texts of 3.
    want = [(1, base), (2, other), docs[3], docs[4], (5, docs[6][1]), (None, base), (None, base), (6, ""), (6, "")]
    assert rows == sorted((str(i), t[:20]) for i, t in want)
