"""The whole n-gram join against brute force: every link, also inside a component, and each document's number of them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tests.llm.test_pairs import brute_links, corpus, frame, sentences
from tracewright.llm import ngram_join


def brute_pairs(rows, n, percent):
    def shingled(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [shingled(t) for _, t in rows]
    both = lambda i, j: len(sets[i] & sets[j])
    return [(i, j) for i in range(len(rows)) for j in range(i) if both(i, j) and 100 * both(i, j) >= percent * len(sets[i] | sets[j])], sets


def counted(rows, n, percent):
    found, sets = brute_pairs(rows, n, percent)
    degree = [0] * len(rows)
    for i, j in found:
        degree[i] += 1
        degree[j] += 1
    return sorted((d, len(sets[i]), degree[i]) for i, (d, _) in enumerate(rows)), found, sets


@pytest.mark.parametrize(("n", "percent", "size"), [(4, 85, 256), (5, 80, 256), (4, 85, 7)])
def test_join_counts_all_links(spark, monkeypatch, n, percent, size):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", size)
    monkeypatch.setattr(ngram_join, "CHUNK", size)
    rows = corpus()
    want, _, _ = counted(rows, n, percent)
    got = ngram_join.joined(frame(spark, rows).repartition(5), n, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == want
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(rows, n, percent)


def test_join_lists_all_links(spark):
    rows = corpus()
    _, found, sets = counted(rows, 4, 85)
    members, links = ngram_join.pairs(frame(spark, rows), 4, 85)
    assert members.count() == len(rows)
    classes = {frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in found if sets[i] != sets[j]}
    assert links.count() == links.distinct().where("a < b").count() == len(classes)


def crowd():
    """2000 near copies; 40 texts of one size that share a rare phrase and do not link; a chain; a very long text and its copy."""
    rng = random.Random(7)
    base = sentences(rng, 120, 5000).split()
    rows = []
    for k in range(2000):
        words = list(base)
        words[k % 120] = f"own{k}"
        rows.append((1000 + k, " ".join(words)))
    for k in range(40):
        rows.append((5000 + k, " ".join(f"u{k}x{i}" for i in range(30)) + " rare phrase of five words " + " ".join(f"u{k}y{i}" for i in range(30))))
    chain = sentences(rng, 100, 5000).split()
    for k in range(30):
        chain = [*chain[3:], *(f"c{k}w{i}" for i in range(3))]
        rows.append((6000 + k, " ".join(chain)))
    long = sentences(rng, 60_000, 5000)
    return [*rows, (7000, long), (7001, long + " end"), (7002, " ".join(long.split()[::-1]))]


def test_a_large_group_of_near_copies(spark):
    """All links by shared words: n_links of the group is known, as two of its texts differ in two words at most."""
    rows = crowd()
    got = {r["doc_id"]: r for r in ngram_join.joined(frame(spark, rows).repartition(8), 4, 85).collect()}
    assert len(got) == len(rows)
    want, _, _ = counted([r for r in rows if r[0] >= 5000], 4, 85)
    assert sorted((d, r["n_shingles"], r["n_links"]) for d, r in got.items() if d >= 5000) == want
    group = [r for d, r in got.items() if d < 3000]
    assert {r["component_id"] for r in group} == {1000} and {r["n_links"] for r in group} == {1999}


def test_join_sql(spark, agree):
    folder = TESTDATA / "sf0.001"
    assert agree(ngram_join.op1_ngram_join(spark, str(folder)), ngram_join.SQL, folder)


def test_one_of_each_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "x")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(7) for c in ("_id", "row", "cid", "n", "component_id", "raw")})
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "None"]
