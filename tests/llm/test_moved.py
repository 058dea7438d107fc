"""What the n-gram join moves and writes: no text that nobody asks for, no filter data of short lists."""

from __future__ import annotations

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from tracewright.llm import ngram_join
from tracewright.session import shared_dir


def test_only_wanted_texts_are_shuffled(spark):
    ids = [None, -5, 2**62, *range(20_000)]
    rows = spark.createDataFrame([(i, b"x") for i in ids], "doc_id long, raw binary")
    wanted = spark.createDataFrame([(k, i) for k, i in enumerate((None, -5, 2**62, 7, 64, 19_999))], "cid long, rep long")
    got = [r["doc_id"] for r in ngram_join._maybe(rows, wanted).collect()]
    assert {None, -5, 2**62, 7, 64, 19_999} <= set(got)
    assert len(got) == len(set(got)) < 100


@pytest.mark.parametrize(("chunk", "cut"), [(256, 0), (4, 3)])
def test_only_cut_lists_are_written_with_their_filters(spark, monkeypatch, chunk, cut):
    """Ten sets that share 60 of 64 shingles, in lists of ten, three and two; those of the last are one component."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    common = rng.integers(1, 1 << 63, 60).astype(np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(1, 1 << 63, 4).astype(np.uint64)])) for _ in range(10)]
    far = np.sort(rng.integers(1, 1 << 63, 64).astype(np.uint64))  # it shares a token with the others, and nothing else
    info = [(k, 64, ngram_join._histogram(h), [int(h[0] >> np.uint64(55))]) for k, h in enumerate([*sets, far])]
    info = spark.createDataFrame([(k, n, bytearray(h), b) for k, n, h, b in info], "cid long, n int, hist binary, before array<int>")
    rest = [(7, k, 64, 0, k) for k in range(10)] + [(8, k, 64, 1, k) for k in (0, 1, 10)] + [(9, k, 64, 0, 4) for k in (4, 5)]
    rest = spark.createDataFrame(rest, "token long, cid long, n int, pos int, comp long")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("ngram-chunks-*"))
    got = [tuple(sorted((r["a"], r["b"]))) for r in ngram_join._chunked(rest, info, 85).collect()]
    assert set(got) == set(combinations(range(10), 2))
    assert cut or len(got) == 45  # one task here, which puts out 0, 1 once
    [new] = set(folder.glob("ngram-chunks-*")) - before
    assert spark.read.parquet(str(new)).count() == cut
