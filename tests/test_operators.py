"""Operators that have no SQL, and edge cases, on small fixtures."""

from __future__ import annotations

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracewright.config import DEFAULT
from tracewright.functions import metrics
from tracewright.operators import paths, relay, scoring
from tracewright.operators.components import components
from tracewright.sources import records
from tracewright.streaming import arrivals


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, value double, n long, mix_n long")


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    links += [(1000 + k, 1001 + k) for k in range(60)]  # a long chain
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_taint_stops_at_mixes_and_decays(spark):
    e = _edges(spark, [("a", "b", 1.0, 1, 0), ("b", "c", 1.0, 1, 0), ("a", "m", 1.0, 2, 2), ("c", "a", 1.0, 1, 0)])
    got = {r["node"]: (r["score"], r["path"]) for r in paths.taint(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": (1.0, ["a"]), "b": (0.5, ["a", "b"]), "c": (0.25, ["a", "b", "c"])}


def test_trace_keeps_value(spark):
    e = _edges(spark, [("s", "x", 60.0, 1, 0), ("s", "y", 40.0, 1, 0), ("x", "z", 30.0, 1, 0)])
    got = {r["node"]: (r["received"], r["terminal"]) for r in paths.trace(e, "s", 3).collect()}
    assert got == {"x": (60.0, 30.0), "y": (40.0, 40.0), "z": (30.0, 30.0)}
    assert sum(t for _, t in got.values()) == 100.0
    poison = {r["node"]: r["received"] for r in paths.trace(e, "s", 3, poison=True).collect()}
    assert poison == {"x": 60.0, "y": 40.0, "z": 30.0}


def test_trace_paths_finds_the_best(spark):
    e = _edges(spark, [("s", "a", 3.0, 1, 0), ("s", "b", 1.0, 1, 0), ("a", "t", 1.0, 1, 0), ("b", "t", 1.0, 1, 0), ("a", "s", 1.0, 1, 0)])
    got = {(r["node"], r["rank"]): (r["path"], round(r["confidence"], 6)) for r in paths.trace_paths(e, "s", 3).collect()}
    assert got[("t", 1)] == (["s", "a", "t"], 0.375)
    assert got[("t", 2)] == (["s", "b", "t"], 0.25)


def test_widest_path(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.4), (1, 3, 0.3), (3, 4, 0.8)], "a long, b long, weight double")
    got = {r["node"]: r["width"] for r in paths.widest(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 0.4, 4: 0.4}


def test_peel_chain_lengths(spark):
    links = [(f"t{k}", f"t{k + 1}") for k in range(9)] + [("c1", "c2"), ("c2", "c1")]
    got = paths.peel_chains(spark.createDataFrame(links, "txid string, next string"), 3).collect()
    assert [(r["head"], r["hops"]) for r in got] == [("t0", 9)]


def test_rumor_centrality_prefers_the_middle(spark):
    hops = [("t", "m", f"p{k}", 1.0 + k) for k in range(6)]
    got = {r["ip"]: r["score"] for r in relay.rumor_centrality(spark.createDataFrame(hops, "txid string, src string, dst string, ts double")).collect()}
    assert max(got, key=got.get) == "m"
    assert sum(got.values()) == pytest.approx(1.0)


def test_isolation_forest_marks_the_outlier(spark):
    rng = random.Random(3)
    rows = [(k, "all", rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(300)] + [(999, "all", 12.0, -12.0)]
    got = scoring.isolation_forest(spark.createDataFrame(rows, "entity long, group string, x double, y double"), ["x", "y"])
    top = got.orderBy(F.col("score").desc()).first()
    assert (top["entity"], top["score"]) == (999, 1.0)


def test_stacker_weights_are_not_negative(spark):
    rows = [(k / 100, 1 - k / 100, int(k > 60)) for k in range(100)]
    w, _ = scoring.stacker(spark.createDataFrame(rows, "good double, bad double, label int"), ["good", "bad"])
    assert w["good"] > 0 and w["bad"] >= 0


def test_auc_without_one_class(spark):
    got = metrics.auc(spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int"), "p", "y").first()
    assert got["positives"] == 0 and got["auc"] is None


GOOD = {
    "timestamp": "2024-01-01T00:00:00Z", "src_ip": "1.2.3.4", "dst_ip": "::1", "src_port": "1", "dst_port": "65535", "txid": "t1", "input_addresses": ["a"],
    "input_amounts": ["1.5"], "output_addresses": ["b", "c"], "output_amounts": ["1", "0.4"], "fee": "0.1", "script_type": "p2pkh", "geo_country": None,
    "asn": None, "tx_version": None, "locktime": None,
}


def test_json_ingest_and_quarantine(spark, tmp_path):
    bad = GOOD | {"txid": " ", "src_port": "70000", "output_amounts": ["1"], "fee": "-1"}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"records": [GOOD, bad]}))
    good, quarantined = records.ingest(records.read(spark, str(path), wrapper="records"))
    assert [(r["txid"], r["output_amounts"], r["src_port"]) for r in good.collect()] == [("t1", [1.0, 0.4], 1)]
    reasons = quarantined.first()["reason"].split("; ")
    assert reasons == ["port out of range", "empty txid", "mismatched output array lengths", "negative amount"]
    assert json.loads(quarantined.first()["raw"])["fee"] == "-1"


def test_csv_and_xml_agree(spark, tmp_path):
    names = list(GOOD)
    cell = lambda v: "" if v is None else ";".join(v) if isinstance(v, list) else v
    (tmp_path / "r.csv").write_text(",".join(names) + "\n" + ",".join(cell(GOOD[n]) for n in names) + "\n")
    xml = lambda n, v: "" if v is None else f"<{n}>{''.join(f'<item>{x}</item>' for x in v) if isinstance(v, list) else v}</{n}>"
    (tmp_path / "r.xml").write_text(f"<records><record>{''.join(xml(n, GOOD[n]) for n in names)}</record></records>")
    got = [records.ingest(records.read(spark, str(tmp_path / f"r.{k}")))[0].drop("source_file", "row").collect() for k in ("csv", "xml")]
    assert got[0] == got[1] and len(got[0]) == 1


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        records.read(spark, "x.toml")


def test_arrivals_take_each_key_once(spark, tmp_path):
    schema = "k long, v string"
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "b"), (3, "c"), (3, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    files = tmp_path / "flat"
    files.mkdir()
    for n, f in enumerate(sorted((tmp_path / "in").rglob("part-*.parquet"))):
        f.rename(files / f"{n}.parquet")
    typed = spark.createDataFrame([], schema).schema
    got = arrivals.drained(spark, str(files), typed, "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, "b"), (3, "c")]


def test_new_alerts(spark):
    f = lambda *xs: spark.createDataFrame([(x,) for x in xs], "entity string")
    assert [r[0] for r in arrivals.new_alerts(f("a", "b", "c"), f("a"), f("a", "b")).collect()] == ["b"]


def test_sizes_and_peel_ratios_gather_no_list(spark):
    from tracewright.operators import ledger

    txs = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 0.0), ("c", 3.0, 0.0), ("d", 4.0, 0.0)], "txid string, ts double, fee double")
    outs = spark.createDataFrame([("a", 0, "x", 4.0), ("a", 1, "y", 1.0), ("b", 0, "x", 1.0), ("c", 0, "x", None), ("c", 1, "x", 2.0)], "txid string, idx int, addr string, value double")
    ins = outs.select("txid", "idx", "addr", "value")
    f = ledger.tx_features(txs, ins, outs).select("txid", "n_in", "n_out", "peel_ratio")
    assert {tuple(r) for r in f.collect()} == {("a", 2, 2, 0.25), ("b", 1, 1, None), ("c", 1, 2, 1.0), ("d", 0, 0, None)}
    assert "collect_list" not in f._jdf.queryExecution().optimizedPlan().toString()


def test_layering_works_features_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(n):
        seen.add(1)
        return n

    txs = spark.createDataFrame([("s", 0.0), ("m", 1.0), ("z", 2.0)], "txid string, ts double")
    n_out = F.udf(told, "int")(F.when(F.col("txid") == "s", 3).otherwise(1))
    f = txs.withColumns({"n_in": F.lit(9), "n_out": n_out, "coinjoin": F.lit(False)})
    outs = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("m", "d")], "txid string, addr string")
    ins = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c"), ("z", "d")], "txid string, addr string")
    spender = ins.join(txs, "txid")
    c = replace(DEFAULT, layering_outs=3, layering_ins=1, layering_hops=1)
    assert [tuple(r)[:3] for r in paths.layering(txs, f, ins, outs, spender, c).collect()] == [("s", "m", 1)]
    assert seen.value == 3
