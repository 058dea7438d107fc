"""Work that few keys hold is dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tracewright.operators import scoring, tags
from tracewright.plans import adapters
from tracewright.plans.adapters import Views


def test_one_entity_is_not_one_task(spark):
    members = spark.range(2000).select(F.concat(F.lit("w"), "id").alias("node"), F.lit("e").alias("component"))
    rows = spark.range(5).select(F.concat(F.lit("w"), "id").alias("address"), F.lit("x").alias("label"), F.lit("mixer").alias("category"), F.lit("cluster").alias("applies_to"), F.lit(0.5).alias("confidence"), F.lit("b").alias("bundle"))
    got = tags.address_tags(rows, members, spark.createDataFrame([("e", 0.8)], "component string, confidence double"))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5 + 5 * 1999 and max(sizes) < sum(sizes) / 2


def test_the_model_goes_to_the_rows(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], "x", "y" if k % 2 else None) for k in range(40)] + [(40, None, "x", None), (41, "a", None, None), (1, "b", "x", "y")], "txid long, label string, s string, t string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scoring.naive_bayes(rows, ["s", "t"])
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        said = {r["txid"]: r["guess"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert said.keys() == set(range(41)) and all(said[k] == "b" for k in range(1, 40, 2))


def test_tasks_of_the_graph_grow_with_its_lines(spark, monkeypatch):
    v = Views(spark, str(TESTDATA / "sf0.001"))
    monkeypatch.setattr(adapters, "LINES_A_TASK", 300)
    n = v.table("lineitem").count()
    assert v.parts >= n / 300
    sizes = [r["count"] for r in v.graph.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 900  # the session has 8 partitions
