"""Saturation reports on alerts whose causes are known."""

from __future__ import annotations

from tracewright.functions import reports

W = {"a": 1.0, "b": 1.0}


def alerts(spark, rows):
    return reports.alerts_of(spark.createDataFrame(rows, "a double, b double"), W, 0.0, 0.5)


def test_each_cause(spark):
    rows = [(1.0, 0.0), (2.0, 0.5), (2.0, 0.5), (9.0, 1.0), (9.0, 2.0), (3.0, 0.0), (3.00001, 0.0), (1.5, None), (-5.0, 0.0)]
    (r,) = reports.diagnosis(alerts(spark, rows), list(W)).collect()
    assert (r["alerts"], r["own_score"], r["equal_inputs"], r["capped"], r["rounded"]) == (8, 2, 2, 2, 2)
    assert (r["shown"], r["vectors"], r["largest"], r["sharing"], r["collapsed"], r["above_flat"], r["logits"]) == (5, 7, 2, 2, 2, 2, 7)
    assert (r["logit_min"], r["logit_max"]) == (1.0, 11.0)


def test_nothing_over_the_threshold(spark):
    none = alerts(spark, [(-5.0, 0.0)])
    (r,) = reports.diagnosis(none, list(W)).collect()
    assert (r["alerts"], r["shown"], r["collapsed"], r["largest"]) == (0, 0, 0, None)
    assert reports.input_spread(none, list(W)).count() == 0 and reports.nearest_deciles(none, "logit").count() == 0


def test_spread_and_tenths(spark):
    rows = [(float(k), None if k % 2 else 0.0) for k in range(1, 10)]
    got = {r["signal"]: tuple(r)[1:] for r in reports.input_spread(alerts(spark, rows), list(W)).collect()}
    assert got == {"a": (1.0, 5.0, 9.0, 9, 1, 0), "b": (0.0, 0.0, 0.0, 1, 4, 4)}
    d = sorted(tuple(r) for r in reports.nearest_deciles(alerts(spark, rows), "logit").collect())
    assert d == [(k, float(1 + round(8 * k / 10))) for k in range(11)]
    (one,) = {r["value"] for r in reports.nearest_deciles(alerts(spark, [(1.0, 0.0)]), "logit").collect()}
    assert one == 1.0
