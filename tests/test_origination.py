"""The additive origination model, open-set labels, ablation, reasons and validity on small frames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import scoring, validity
from tracewright.operators.origination import Origination, answer_frame


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for t in range(150):
        for p in range(4):
            first = p == t % 4
            out.append((f"c{t % 2}", f"t{t}", f"p{p}", rng.gauss(0.0 if first else 2.0, 0.8), None if rng.random() < 0.2 else rng.gauss(1.0 if first else 0.0, 1.0), rng.random(), int(first), t % 50 == 0, False))
    return spark.createDataFrame(out, "capture string, txid string, peer_ip string, delta double, lead double, noise double, label int, degenerate boolean, scope_out boolean").cache()


def test_origination(spark, rows):
    train, test = rows.where("capture = 'c0'"), rows.where("capture = 'c1'")
    model = Origination.fit(train, ["delta", "lead", "noise"], trees=20).calibrate(train)
    q = model.calibrated(test).where("q < 0 or q > 1")
    assert q.count() == 0
    decided = model.decide(rows)
    assert decided.count() == 150 and decided.where("answered and txid in ('t0', 't50', 't100')").count() == 0
    right = decided.join(rows.where("label = 1").select("txid", F.col("peer_ip").alias("true")), "txid").agg(F.avg((F.col("peer_ip") == F.col("true")).cast("double"))).first()[0]
    assert right > 0.7
    told = model.explain(test)
    scored = model.score(test).select("txid", "peer_ip", "p")
    # The margin is half the log odds; reasons and the mean add up to it.
    off = told.join(scored, ["txid", "peer_ip"]).agg(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-2 * F.col("margin")))))).first()[0]
    assert off < 1e-9
    spread = told.select((F.col("margin") - sum(F.col(f"why_{f}") for f in model.features)).alias("rest")).agg(F.max("rest") - F.min("rest")).first()[0]
    assert abs(spread) < 1e-9
    got = answer_frame(decided, spark.createDataFrame([("t1", 5.0), ("t1", 3.0)], "txid string, ts double"))
    assert got.count() == 150 and got.where("txid = 't1'").first()["ts"] == 3.0


def test_ablation_and_open_set(spark, rows):
    filled = rows.na.fill(0.0)
    table = {r["feature"]: r for r in scoring.ablation(filled.where("capture = 'c0'").withColumn("delta", -F.col("delta")), filled.where("capture = 'c1'").withColumn("delta", -F.col("delta")), ["delta", "noise"]).collect()}
    assert table["delta"]["alone"] > 0.85 > table["delta"]["without"]
    assert scoring.held_out_auc(filled.where("label = 1"), filled, ["delta"]) is None
    known = spark.createDataFrame([(float(k),) for k in range(101)], "novelty double")
    scored = spark.createDataFrame([("a", "x", 5.0, 8), ("b", "x", 99.5, 8), ("c", "x", 5.0, 2)], "txid string, guess string, novelty double, n_tells int")
    assert {r["txid"]: r["answer"] for r in scoring.open_set(scored, known).collect()} == {"a": "x", "b": "unknown", "c": "unknown"}


def test_reasons(spark):
    alerts = spark.createDataFrame([("e", 0.9), ("f", 0.5)], "entity string, risk double")
    found = spark.createDataFrame([("e", "peel", 0.5, "five peels"), ("e", "mix", 0.9, "equal outputs")], "entity string, rule string, score double, reason string")
    tainted = spark.createDataFrame([("e", 2), ("z", 1)], "node string, hops int")
    leads = spark.createDataFrame([("e", "1.1.1.1", 0.2), ("e", "2.2.2.2", 0.7)], "entity string, ip string, score double")
    got = {r["entity"]: r for r in scoring.reasons(alerts, found, tainted, leads).collect()}
    assert got["e"]["reasons"] == ["equal outputs", "five peels", "2 hops from a watched wallet"] and got["e"]["leads"] == ["2.2.2.2", "1.1.1.1"] and got["e"]["patterns"] == ["mix", "peel"]
    assert got["f"]["reasons"] == [] and got["f"]["leads"] == []


def test_validity_answers(spark):
    facts = [("a", 1, False, "x", 1, None, None, 0, False, "btcap:", None), ("b", 5, False, "q.onion", 5, 1.0, 0.1, 7, True, "pcap:x", 3), ("c", 5, False, "y", 5, 0.1, 0.1, 0, False, "pcap:x", 0), ("d", 3, True, "z", 3, None, None, 0, False, None, None)]
    frame = spark.createDataFrame(facts, "txid string, n_candidates int, scope_out boolean, peer string, n int, first_gap double, later_gap double, equal_outputs int, coinjoin boolean, source string, unreadable_flows int")
    got = {r["txid"]: r for r in validity.verdicts(frame, "txid", "peer").collect()}
    assert (got["a"]["reason"], got["a"]["tier"]) == ("DEGENERATE", "ABSTAIN") and (got["c"]["reason"], got["c"]["tier"]) == ("VALID", "PASS") and got["d"]["reason"] == "NOT_REACHABLE"
    assert got["b"]["reasons"] == "COINJOIN,TOR_ONION,DANDELION_STEM,V2_PASSIVE_TAP" and (got["b"]["tier"], got["b"]["confidence"]) == ("QUALIFIED", 0.7)
    told = {p: {r["txid"]: (r["kind"], r["ip"], r["onion"], r["input_ownership"]) for r in validity.answers(validity.verdicts(frame, "txid", "peer"), p).collect()} for p in validity.POLICIES}
    assert told["tiered"]["b"] == ("onion_identity", None, "q.onion", validity.NOT_OWNERS) and told["tiered"]["a"] == (None, None, None, None) or told["tiered"]["a"][0] is None
    assert told["off"]["a"][0] == "ip_attribution" and told["binary"]["b"][0] is None and told["binary"]["c"][0] == "ip_attribution"
