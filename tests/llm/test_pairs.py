"""N-gram join, suffix-array deduplication and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tracewright.llm import ngram_join, repeats, simhash

#: Names that the operators use inside; here they are columns of the input.
EXTRA = "n long, cid long, value string, kind string, block long, row long, g long, rep long"


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in EXTRA.split(", "):
        name, kind = c.split()
        docs = docs.withColumn(name, F.lit("1").cast(kind))
    return docs


def sentences(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three four"), (7, "x" * 3000), (7, "x" * 3000)]
    k = 10
    for _ in range(12):
        base = sentences(rng, rng.choice([30, 80, 200]), 5000)
        for _ in range(rng.randrange(1, 7)):
            words = base.split()
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
            rows.append((k, " ".join(words)))
            k += 1
    star = sentences(rng, 150, 5000).split()  # a large group: each differs from the others in its own words
    for j in range(60):
        words = list(star)
        words[(j * 2) % 150] = f"own{j}"
        rows.append((k, " ".join(words)))
        k += 1
    return rows


def brute_links(rows, n, percent):
    def shingled(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_finds_all_components(spark, n, percent):
    rows = corpus()
    got = ngram_join.linked(frame(spark, rows).repartition(5), n, percent)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, n, percent)


def test_join_of_nothing_and_null_ids(spark):
    assert ngram_join.linked(frame(spark, []), 4, 85).count() == 0
    got = ngram_join.linked(frame(spark, [(None, "a b c d e"), (5, "a b c d e"), (None, None)]), 4, 85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got if r["n_shingles"]) == [(-1, 5), (5, 5)]


def test_one_of_each_keeps_the_smallest(spark):
    rows = corpus()
    kept = sorted(r["doc_id"] for r in ngram_join.one_of_each(frame(spark, rows), 5, 80).collect())
    assert kept == sorted(d for d, _, c in brute_links(rows, 5, 80) if d == c)


def brute_repeats(rows, length):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 80, 200, 400)]
    rows = [(1, None), (2, ""), (3, "a" * 700), (4, "b" + "a" * 120 + "c"), (5, "ab" * 200), (6, "x" + "ab" * 100), (7, shared[4]), (8, shared[4])]
    for k in range(20, 70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(shared)
            a = rng.randrange(0, 20)
            parts += [p[a:], "".join(rng.choice("mnopq ü") for _ in range(rng.randrange(0, 70)))]
        rows.append((k, "".join(parts)))
    rows.append((30, "doubled id " + shared[5]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [600, 1 << 20])
def test_repeated_bytes_go(spark, block):
    rows = passages()
    got = repeats.deduplicated(frame(spark, rows).repartition(3), block_bytes=block).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows, 50)


def test_repeated_bytes_sql(spark, agree):
    folder = TESTDATA / "sf0.001"
    assert agree(repeats.op4_suffix_dedup(spark, str(folder)), repeats.SQL, folder)


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, a), (2, "x" + a[:70_000] + "y" + a[70_040:]), (3, a[::-1]), (3, a[::-1])]
    got = repeats.deduplicated(frame(spark, rows), block_bytes=1 << 16).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows, 50)


def test_repeats_of_nothing(spark):
    assert repeats.deduplicated(frame(spark, [])).count() == 0


def test_intervals_are_maximal():
    import numpy as np

    text = "banana$"
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(9) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= 7 or b + k >= 7), 9)
    lcp = np.array([0] + [common(a, b) for a, b in zip(sa, sa[1:], strict=False)])
    n, lo, hi = repeats.lcp_intervals(lcp, 1)
    left = np.array([ord(text[i - 1]) if i else -1 for i in sa])
    found = {text[sa[a] : sa[a] + k] for k, a, e in zip(n, lo, hi, strict=True) if repeats.left_diverse(left, np.array([a]), np.array([e]))[0]}
    assert found == {"a", "ana"}  # na is always preceded by a


def test_simhash_votes(spark):
    rows = [(1, "a b c d e f g a b c d e"), (2, "short text"), (3, None), (4, " "), (5, "a b c d e f g a b c d e")]
    docs = frame(spark, rows)
    w, shingles = simhash.terms(F.col("text"))
    hashed = {r["doc_id"]: r["h"] or [] for r in docs.select("doc_id", "text", w.alias("_w")).select("doc_id", shingles.alias("h")).collect()}
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(docs, ["doc_id"]).collect()}
    for d, hs in hashed.items():
        assert got[d] == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    assert got[1] == got[5] and got[3] == got[4] == 0


def test_block_tables_find_all_within_radius(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) - (1 << 63) for _ in range(200)}
    for x in list(fps)[:60]:
        for _ in range(4):
            y = x
            for k in rng.sample(range(63), rng.randrange(1, 6)):
                y ^= 1 << k
            fps.add(y)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    some = sorted(fps)[::7]
    got = {(r[0], r[1]) for r in simhash.within(spark.createDataFrame([(x,) for x in some], "fp long"), table).collect()}
    assert got == {(a, b) for a in some for b in fps if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_simhash_edits(spark):
    rng = random.Random(2)
    rows = [(k * 97, sentences(rng, rng.randrange(0, 40))) for k in range(50)] + [(5, None), (6, "é" * 9)]
    got = {r["doc_id"]: r for r in simhash.digest(frame(spark, rows)).collect()}
    order = sorted((d, t or "") for d, t in rows)
    for k, (d, t) in enumerate(order):
        follow = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[1][:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bits = (int(r["fingerprint"], 16) ^ int(got[follow[0]]["fingerprint"], 16)).bit_count()
        assert r["near_next"] == 1 - bits / 64
    assert len(got) == len(rows)


def test_simhash_of_nothing(spark):
    assert simhash.digest(frame(spark, [])).count() == 0
