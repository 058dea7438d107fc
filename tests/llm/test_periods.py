"""Periodic runs against their definition."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import periods


def brute_runs(w, exponent=4, shortest=6):
    """Every maximal stretch of each period; the smallest period wins."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(lines), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


def word_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        letters = rng.choice([1, 2, 2, 3, 8])
        w = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 6, 7, 30, 90]))]
        for _ in range(rng.randrange(3)):  # nested and neighbouring repeats
            root = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
            root = root * rng.choice([1, 4, 5]) + [rng.randrange(letters)] * rng.randrange(2)
            at = rng.randrange(len(w) + 1)
            w[at:at] = root * rng.randrange(2, 7) + root[: rng.randrange(len(root) + 1)]
        out.append(w)
    return out


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 31, 32, 33, 500, 3000):
        a = rng.integers(0, 1000, n)
        lo = rng.integers(0, n, 400)
        hi = np.minimum(n - 1, lo + rng.integers(0, n, 400))
        assert (periods.RangeMin(a)(lo, hi) == [a[x : y + 1].min() for x, y in zip(lo, hi, strict=True)]).all()


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_the_definition(seed):
    texts = word_texts(seed, 150)
    got = periods.runs_in([np.array(t, np.int64) for t in texts])
    assert [[tuple(map(int, r)) for r in g] for g in got] == [brute_runs(t) for t in texts]


def test_other_bounds(spark):
    texts = word_texts(99, 150)
    got = periods.runs_in([np.array(t, np.int64) for t in texts], 5, 9)
    assert [[tuple(map(int, r)) for r in g] for g in got] == [brute_runs(t, 5, 9) for t in texts]
    with pytest.raises(ValueError):
        periods.collapsed(spark.createDataFrame([], "doc_id long, text string"), exponent=3)


def test_long_periodic_text():
    root = [k * k % 97 for k in range(1000)]
    got = [tuple(map(int, r)) for r in periods.runs_in([np.array([500] + root * 60 + [600], np.int64)])[0]]
    assert (1, 60000, 1000) in got and len([r for r in got if r[2] == 97]) == 60


def test_digest(spark):
    rng = random.Random(4)
    spaces = lambda w: "".join(x + rng.choice([" ", "\n", " \t", "\x0b"]) for x in w)
    texts = [spaces([f"wörd{x}" for x in w]) for w in word_texts(5, 160)]
    texts += [None, "", " \n", "a\u00a0b c", "one", "x " * 7000, " ".join(f"u{k}" for k in range(9000))]
    rows = [(k if k % 11 else None, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "y y y y y y"), (None, "z z z z z z z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("raw", "runs", "collapsed", "start", "_g", "_n", "_w", "_b")})
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0] is not None and r[1]) > 5
    for frame in (docs.repartition(3), docs.coalesce(1)):
        got = sorted(str(tuple(r)) for r in periods.digest(frame).collect())
        assert got == sorted(str(brute(*r)) for r in rows)
    assert periods.digest(docs.limit(0)).count() == 0


def test_small_slices(spark, monkeypatch):
    texts = [" ".join(map(str, w)) for w in word_texts(6, 60)]
    raw = [t.encode() for t in texts]
    whole = periods._slice(raw, 4, 6)
    single = [periods._slice([x], 4, 6) for x in raw]
    assert whole[1] == [s[1][0] for s in single] and [r.tolist() for r in whole[0]] == [s[0][0].tolist() for s in single]
