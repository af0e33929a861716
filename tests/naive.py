"""Ranking as plain loops over dictionaries: what the plans are held against."""

from __future__ import annotations

import math
from collections import Counter


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def running_mean(lengths: list[int | None]) -> float:
    mean = 0.0
    for n, length in enumerate(lengths, 1):
        if length is not None:
            mean = (mean * (n - 1) + length) / n
    return mean


def scores(docs: list[dict], props: list[str], words, term: str, exact=False, prefix=True, tolerance=0, threshold=1.0, boost=None, k=1.2, b=0.75, d=0.5, allowed=None) -> dict[int, float]:
    """seq -> score; docs: of seq and fields in order of insertion."""
    tokens = list(dict.fromkeys(words(term))) or [""]
    n_docs = len(docs)
    fields = {p: {x["seq"]: words(x[p]) for x in docs if x.get(p) is not None} for p in props}
    counts = {p: {s: Counter(w) for s, w in fields[p].items()} for p in props}
    means = {p: running_mean([len(fields[p][x["seq"]]) if x["seq"] in fields[p] else None for x in docs]) for p in props}
    df = {p: Counter(w for c in counts[p].values() for w in c) for p in props}
    idf = lambda n: math.log(1 + (n_docs - n + 0.5) / (n + 0.5))

    def matches(token: str, word: str) -> bool:
        if exact or (not prefix and not tolerance):
            return word == token
        return word.startswith(token) or (tolerance > 0 and edit_distance(word, token) <= tolerance)

    events = []
    for p in props:
        for i, token in enumerate(tokens):
            for word, n in df[p].items():
                if not matches(token, word):
                    continue
                share = 1.0
                if word != token:
                    share = 0.5 if token not in df[p] or idf(n) == 0 else 0.5 * min(1.0, idf(df[p][token]) / idf(n))
                for s, c in counts[p].items():
                    if word in c:
                        length = len(fields[p][s])
                        w = idf(n) * (d + c[word] * (k + 1)) / (c[word] + k * (1 - b + b * length / means[p]))
                        events.append((s, p, i, w * share * (boost or {}).get(p, 1)))
    kept = [e for e in events if allowed is None or e[0] in allowed]
    n = len(tokens)

    def summed(rows) -> dict[int, float]:
        out: dict[int, float] = {}
        for s, _, _, w in rows:
            out[s] = out.get(s, 0.0) + w
        return out

    if n == 1 or threshold >= 1:
        return summed(kept)
    if threshold <= 0:
        cover = lambda rows: {(s, p) for s, p in {(e[0], e[1]) for e in rows} if len({e[2] for e in rows if e[:2] == (s, p)}) == n}
        good, docs_with = {p for _, p in cover(events)}, {s for s, _ in cover(kept)}
        return summed(e for e in kept if e[1] in good and e[0] in docs_with)
    per_field = Counter((e[0], e[1]) for e in kept)
    full = {s for (s, _), c in per_field.items() if c == n}
    every = summed(kept)
    if not full:
        return every
    part = sorted((s for s in every if s not in full), key=lambda s: (-round(every[s], 9), s))
    part = part[: math.ceil(round(threshold * len(part), 9))]
    return {s: every[s] for s in [*full, *part]}
