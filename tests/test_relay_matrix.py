"""The relay matrix without steps that nobody asked for, and its scores against the estimator."""

from __future__ import annotations

import random

from tests.conftest import TESTDATA
from tracewright import plans
from tracewright.operators import matrix, relay, validity


def test_no_medians_for_verdicts_and_places(spark, monkeypatch):
    monkeypatch.setattr(relay, "running_medians", None)
    known = plans.queries()
    for name in ("q_relay_matrix", "q_policies"):
        assert known[name](spark, str(TESTDATA / "sf0.001")).count() > 0


def test_scores_are_the_estimators(spark):
    rng = random.Random(3)
    rows = [(c, f"t{t}", f"p{p}", float(rng.randrange(4))) for c in "ab" for t in range(6) for p in rng.sample(range(9), rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "capture string, txid string, peer_ip string, ts double")
    got = {(r["capture"], r["txid"], r["peer_ip"]): (r["est_first_timestamp"], r["est_first_timestamp_place"]) for r in matrix.candidate_scores(df).collect()}
    hops = matrix.relay_frame(df.selectExpr("concat(capture, txid) AS txid", "peer_ip", "ts"), "o")
    want = {(r["txid"], r["ip"]): r["score"] for r in relay.first_timestamp(relay.tree_nodes(hops)).where("ip <> 'o'").collect()}
    assert {(c + t, p): s for (c, t, p), (s, _) in got.items()} == want
    for (c, t, p), (s, place) in got.items():
        assert place == 1 + sum(x > s for (d, u, _), (x, _) in got.items() if (d, u) == (c, t))


def test_a_whole_matrix(spark):
    from tracewright.plans.adapters import Views

    v = Views(spark, str(TESTDATA / "sf0.001"))
    whole, lean = (matrix.matrix(v.captured, v.hosts, {"192.0.2.1"}, medians=m) for m in (True, False))
    assert set(whole.columns) - set(lean.columns) == {"gap_median"}
    seen = v.captured.where("direction = 'inbound' and message_type <> 'inv_wtx'").selectExpr("concat(capture, '/', txid) AS txid", "concat(capture, '/', peer_ip) AS peer", "ts")
    want = {(r["txid"], r["peer"]): (r["gap_median"], r["rate"], r["firsts_before"]) for r in relay.peer_history(seen).collect()}
    assert {(f"{r['capture']}/{r['txid']}", f"{r['capture']}/{r['peer_ip']}"): (r["gap_median"], r["rate"], r["firsts_before"]) for r in whole.collect()} == want


def test_policies_are_one_pass(spark):
    rows = validity.policy_table(spark.createDataFrame([("PASS", 1), ("ABSTAIN", 1), ("QUALIFIED", 0), ("ANNOTATE", 1)], "tier string, right int"))
    assert {r["policy"]: (r["answered"], r["right"]) for r in rows.collect()} == {"off": (4, 3), "tiered": (3, 2), "binary": (1, 1)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    none = validity.policy_table(spark.createDataFrame([], "tier string, right int"))
    assert {(r["answered"], r["right"]) for r in none.collect()} == {(0, 0)}
