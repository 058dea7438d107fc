"""The blended estimator and the running medians against plain Python."""

from __future__ import annotations

import random
from statistics import median

from pyspark.sql import functions as F

from tracewright.functions import metrics
from tracewright.operators import relay


def test_blend_is_the_weighted_sum(spark):
    hops = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "a", "c", 2.0), ("t", "b", "d", 3.0), ("u", "x", "y", 1.0)], "txid string, src string, dst string, ts double")
    first, rumor = relay.first_timestamp(relay.tree_nodes(hops)), relay.rumor_centrality(hops)
    want = {(r["txid"], r["ip"]): 0.6 * r["score"] for r in first.collect()}
    for r in rumor.collect():
        want[r["txid"], r["ip"]] += 0.4 * r["score"]
    got = {(r["txid"], r["ip"]): r["score"] for r in relay.blended(first, rumor).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_running_medians_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(f"k{k}", i, None if rng.random() < 0.1 else float(rng.randrange(20))) for k in range(4) for i in range(1, 1 + (1, 2, 17, 120)[k])]
    got = {(r["key"], r["at"]): r["median"] for r in relay.running_medians(spark.createDataFrame(rows, "key string, at long, value double"), "key").collect()}
    for key, at, _ in rows:
        earlier = [x for k, i, x in rows if k == key and i < at and x is not None]
        assert got.get((key, at)) == (median(earlier) if earlier else None)
    values = [x for _, _, x in rows if x is not None]
    found = metrics.quantiles(spark.createDataFrame(rows, "key string, at long, value double"), "value", [0.0, 0.25, 0.5, 1.0])
    ordered = sorted(values)
    at = lambda q: ordered[int(q * (len(ordered) - 1))] + (q * (len(ordered) - 1) % 1) * (ordered[min(int(q * (len(ordered) - 1)) + 1, len(ordered) - 1)] - ordered[int(q * (len(ordered) - 1))])
    assert all(abs(a - at(q)) < 1e-9 for a, q in zip(found, [0.0, 0.25, 0.5, 1.0], strict=True))
    placed = metrics.placed(spark.createDataFrame(rows, "key string, at long, value double"), [F.col("value").desc_nulls_last(), F.col("key").asc(), F.col("at").asc()]).collect()
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1]))
    assert {(r["key"], r["at"]): r["place"] for r in placed} == {(k, i): n for n, (k, i, _) in enumerate(want, 1)}
