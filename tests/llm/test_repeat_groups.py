"""Maximal repeats with their occurrences, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

from tracewright.llm import repeats


def brute(texts, length):
    """(bytes, places) of every maximal repeat: a place is (row, offset)."""
    out = set()
    places = defaultdict(set)
    for d, t in enumerate(texts):
        for i in range(len(t)):
            for e in range(i + length, len(t) + 1):
                places[t[i:e]].add((d, i))
    for s, at in places.items():
        if len(at) < 2:
            continue
        left = {texts[d][i - 1] if i else ("none", d, i) for d, i in at}
        right = {texts[d][i + len(s)] if i + len(s) < len(texts[d]) else ("none", d, i) for d, i in at}
        if len(left) > 1 and len(right) > 1:
            out.add((s, frozenset(at)))
    return out


def test_maximal_repeats(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PART", 8)
    rng = random.Random(6)
    shared = ["".join(rng.choice("abé ") for _ in range(n)) for n in (7, 8, 9, 30, 90)]
    texts = ["", "a" * 40, "b" + "a" * 30 + "c", "ab" * 20, shared[4], shared[4], "x" + shared[3] + "y" + shared[3]]
    for _ in range(16):
        texts.append("".join(rng.choice(shared)[rng.randrange(4) :] + rng.choice(["", "m", "nü"]) for _ in range(rng.randrange(1, 4))))
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string").repartition(3)
    groups = defaultdict(set)
    for r in repeats.maximal_repeats(docs, 8).collect():
        groups[r["repeat"], r["n_bytes"]].add((r["doc_id"], r["at"]))
    got = [(raw[min(p)[0]][min(p)[1] :][:n], frozenset(p)) for (_, n), p in groups.items()]
    assert len(got) == len(set(got))
    assert set(got) == brute(raw, 8)


def test_maximal_repeats_of_nothing(spark):
    assert repeats.maximal_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
