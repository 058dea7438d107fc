"""Repeats in texts with NUL and other low characters, against brute force."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_pairs import brute_repeats, frame
from tracewright.llm import repeats


@pytest.mark.parametrize("block", [900, 1 << 20])
def test_low_bytes(spark, block):
    rng = random.Random(12)
    shared = ["".join(rng.choice("\0\1\2\3") for _ in range(n)) for n in (50, 52, 60, 120)] + ["\0" * 70, "".join(rng.choice("abc") for _ in range(50))]
    rows = []
    for k in range(180):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(shared)
            parts += [p[rng.randrange(0, 6) :] if rng.random() < 0.3 else p, "\0" * rng.choice([0, 0, 1, 2, 5, 60]), "".join(rng.choice("\0\1mn") for _ in range(rng.randrange(0, 9)))]
        rows.append((k, "".join(parts)))
    got = repeats.deduplicated(frame(spark, rows).repartition(3), block_bytes=block).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows, 50)
