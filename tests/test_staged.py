"""Staged arrivals: stops between any two steps, failures, replays, the feed."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tracewright.streaming import staged

SCHEMA = "k long, who string, value long"


def over(limit):
    """Whoever's values pass a limit is raised once."""

    def score(new, known):
        total = new.unionByName(known).groupBy("who").agg(F.sum("value").alias("v")).where(F.col("v") > limit)
        before = known.groupBy("who").agg(F.sum("value").alias("v")).where(F.col("v") > limit)
        return total.join(before, "who", "left_anti").select(F.col("who").alias("subject"), F.col("v").cast("string").alias("detail"))

    return score


def put(spark, folder, name, rows):
    """One file, made elsewhere, that appears as a whole."""
    made = folder.parent / f"made-{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(made))
    next(made.glob("part-*.parquet")).rename(folder / f"{name}.parquet")


@pytest.fixture
def places(spark, tmp_path):
    (tmp_path / "in").mkdir()
    typed = spark.createDataFrame([], SCHEMA).schema
    put(spark, tmp_path / "in", "0", [(1, "a", 3), (2, "b", 1), (2, "b", 1)])
    make = lambda score=over(4), **more: staged.Inbox(spark, str(tmp_path / "in"), f"file://{tmp_path}/case", typed, "k", score, **more)
    return tmp_path / "in", make


def test_arrivals_replays_and_alerts(spark, places):
    folder, make = places
    make().drain()
    put(spark, folder, "1", [(2, "b", 1), (3, "a", 2), (4, "c", 9)])
    box = make().drain()
    assert sorted(tuple(r) for r in box.rows().collect()) == [(1, "a", 3), (2, "b", 1), (3, "a", 2), (4, "c", 9)]
    assert sorted((r["subject"], r["detail"], r["batch"]) for r in box.alerts().collect()) == [("a", "5", 1), ("c", "9", 1)]
    assert [(r["number"], r["rows"], r["repeats"]) for r in box.markers().orderBy("number").collect()] == [(0, 2, 1), (1, 2, 1)]
    assert [(r["sequence"], r["kind"], r["subject"]) for r in box.feed().collect()] == [(1, "arrival", "0"), (2, "alert", "a"), (3, "alert", "c"), (4, "arrival", "1")]
    box.take(spark.createDataFrame([(9, "z", 99)], SCHEMA), 1)  # a replay of a batch that is done
    assert box.rows().count() == 4 and box.alerts().count() == 2
    small = make(ring=2)
    assert [r["sequence"] for r in small.feed(1).collect()] == [3, 4] and (small.missed(1), small.missed(3)) == (1, 0)


@pytest.mark.parametrize(("part", "late"), [("staged", True), ("alerts", False), ("events", True), ("markers", False), ("markers", True)])
def test_a_stop_at_any_step_loses_nothing(spark, places, monkeypatch, part, late):
    """The writer dies before or after it has written a part of the batch, as a killed driver would."""
    _, make = places
    write = staged.Inbox._write

    def dies(self, rows, to, number):
        if to == part and not late:
            raise RuntimeError("killed")
        out = write(self, rows, to, number)
        if to == part:
            raise RuntimeError("killed")
        return out

    with monkeypatch.context() as m:
        m.setattr(staged.Inbox, "_write", dies)
        with pytest.raises(StreamingQueryException, match="killed"):
            make(over(2)).drain()
    box = make(over(2)).drain()
    assert sorted(tuple(r) for r in box.rows().collect()) == [(1, "a", 3), (2, "b", 1)]
    assert [tuple(r) for r in box.alerts().select("subject", "detail").collect()] == [("a", "3")]
    assert [r["sequence"] for r in box.feed().collect()] == [1, 2] and box.markers().count() == 1


def test_bad_files_and_bad_scores_are_set_aside(spark, places):
    folder, make = places
    bad = lambda new, known: new.select(F.raise_error(F.lit("no model")).cast("string").alias("subject"), F.lit("").alias("detail"))
    box = make(bad).drain()
    assert box.rows().count() == 0 and sorted(r["k"] for r in box.failed().collect()) == [1, 2]
    said = box.markers().first()
    assert said["status"] == "failed" and said["reason"].startswith("score: ") and len(said["files"]) == 1
    (folder / "1.parquet").write_bytes(b"PAR1 is no parquet")
    put(spark, folder, "2", [(7, "q", 1)])
    box = make().drain()
    assert [tuple(r) for r in box.rows().collect()] == [(7, "q", 1)]
    marks = {r["number"]: (r["status"], r["reason"]) for r in box.markers().collect()}
    assert [marks[k][0] for k in sorted(marks)] == ["failed", "failed", "committed"] and marks[1][1].startswith("read: ")
    assert any("1.parquet" in f for r in box.markers().where("number = 1").collect() for f in r["files"])
