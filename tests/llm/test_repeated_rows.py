"""SimHash of rows that repeat."""

from __future__ import annotations

from tests.llm.test_pairs import frame
from tracewright.llm import simhash


def test_equal_rows_are_documents_of_their_own(spark):
    rows = [(100, "one two three four five six")] * 3 + [(200, "other words")] * 2 + [(None, None)] * 2
    got = simhash.digest(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["100"] * 3 + ["200"] * 2 + ["None"] * 2
    assert {(r["doc_id"], r["n_near"]) for r in got} == {(100, 2), (200, 1), (None, None)}
