"""The read API, intel sources, seals and custody on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracewright import engine
from tracewright.operators import matrix
from tracewright.sources import intel


@pytest.fixture(scope="module")
def case(spark):
    """a1 and a2 spend together to b; b pays c and d; d pays e."""
    txs = [("t1", 0.0, 0.0), ("t2", 86400.0, 0.0), ("t3", 172800.0, 0.0)]
    ins = [("t1", 0, "a1", 6.0), ("t1", 1, "a2", 4.0), ("t2", 0, "b", 10.0), ("t3", 0, "d", 7.0)]
    outs = [("t1", 0, "b", 10.0), ("t2", 0, "c", 3.0), ("t2", 1, "d", 7.0), ("t3", 0, "e", 7.0)]
    alerts = [("b", 0.9, 1, 1, 0.5, 3), ("d", 0.9, 2, None, 0.1, 2), ("e", 0.4, 0, 2, 0.0, 1)]
    tags = [("e", "X", "mixer", 1.0, "address", "s", "2024", "b"), ("a1", "Y", "scam", 0.5, "cluster", "s", "2024", "b")]
    return engine.Case(
        spark.createDataFrame(txs, "txid string, ts double, fee double"), spark.createDataFrame(ins, "txid string, idx int, addr string, value double"), spark.createDataFrame(outs, "txid string, idx int, addr string, value double"),
        spark.createDataFrame(alerts, "entity string, risk double, rule_kinds int, taint_hops int, lead_confidence double, tx_count int"), spark.createDataFrame(tags, intel.TAG + ", bundle string"),
    )


def test_read_api(spark, case):
    e = engine.Engine(spark, case)
    rows = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    assert rows(e.members, "node", "component") == [("a1", "a1"), ("a2", "a1"), ("b", "b"), ("d", "d")] or rows(e.members.where("node like 'a%'"), "node", "component") == [("a1", "a1"), ("a2", "a1")]
    assert rows(e.graph, "src", "dst", "value") == [("a1", "b", 10.0), ("b", "c", 3.0), ("b", "d", 7.0), ("d", "e", 7.0)]
    s = e.summary().first()
    assert (s["entities"], s["edges"]) == (5, 4)
    assert rows(e.neighbours("b"), "direction", "other") == [("in", "a1"), ("out", "c"), ("out", "d")]
    assert rows(e.subgraph("b", 1), "src", "dst") == [("a1", "b"), ("b", "c"), ("b", "d")]
    assert rows(e.trace("a1", 3, 5.0), "node", "hop") == [("a1", 0), ("b", 1), ("d", 2), ("e", 3)]
    assert rows(e.trace("e", 1, forward=False), "node", "hop") == [("d", 1), ("e", 0)]
    assert rows(e.path("a1", "e"), "step", "node") == [(0, "a1"), (1, "b"), (2, "d"), (3, "e")]
    assert {r["node"]: r["score"] for r in e.taint("b").collect()} == {"b": 1.0, "c": 0.5, "d": 0.5, "e": 0.25}
    assert {r["node"]: round(r["received"], 6) for r in e.value("a1", 3).collect()} == {"b": 10.0, "c": 3.0, "d": 7.0, "e": 7.0}
    assert rows(e.exits("a1", 3).candidates, "node", "rank") == [("e", 1)]
    assert rows(e.exits("a2", 3, kind="address").candidates, "seed", "node") == [("a1", "e")]
    assert e.exits("a1", 3, category="exchange/VASP").candidates.count() == 0
    assert rows(e.cluster("a1"), "node", "sent") == [("a1", 6.0), ("a2", 4.0)]
    assert [r["entity"] for r in e.queue().orderBy("place").collect()] == ["d", "b", "e"]
    assert [(r["entity"], r["total"]) for r in e.page(1, 1, 0.5).collect()] == [("b", 2)]
    assert rows(e.tagged(), "entity", "score") == [("a1", 0.5), ("e", 0.5)]
    assert e.payload(e.neighbours("b").selectExpr("'b' as src", "other as dst", "value", "n")).where("kind = 'node'").count() == 4


def test_fold_in_and_sinks(spark, case, tmp_path):
    e = engine.Engine(spark, case)
    more = engine.Case(spark.createDataFrame([("t4", 3e5, 0.0)], case.txs.schema), spark.createDataFrame([("t4", 0, "e", 7.0)], case.ins.schema), spark.createDataFrame([("t4", 0, "f", 7.0)], case.outs.schema))
    assert e.fold_in(more).graph.where("src = 'e' and dst = 'f'").count() == 1
    with pytest.raises(ValueError, match="t1"):
        e.fold_in(engine.Case(case.txs.limit(1), case.ins, case.outs))
    for kind in ("csv", "json", "xml"):
        for _ in range(2):
            engine.write_dataset(case.outs, str(tmp_path / kind), kind)
        read = spark.read.option("rowTag", "record").option("header", "true").format(kind).load(str(tmp_path / kind))
        assert read.count() == 8
    engine.write_payload(case.alerts, {"degraded": False}, str(tmp_path / "payload"))
    assert spark.read.json(str(tmp_path / "payload" / "alerts")).count() == 3
    for _ in range(2):
        e.feedback(str(tmp_path / "feedback"), "b", "confirmed", "me", "now")
    assert spark.read.parquet(str(tmp_path / "feedback")).count() == 2


def test_bundles_and_seals(spark, case, tmp_path):
    at = str(tmp_path / "bundle")
    intel.write_bundle(case.tags.drop("bundle"), at, "mine", simulated=True)
    assert intel.read_bundle(spark, at).count() == 2
    with pytest.raises(ValueError, match="simulated"):
        intel.read_bundle(spark, at, real_case=True)
    sealed = spark.createDataFrame(intel.seal(spark, at).collect())
    assert intel.seal_hash(sealed) == intel.seal_hash(sealed.orderBy(F.col("path").desc()))
    part = next((tmp_path / "bundle" / "tags").glob("part-*"))
    part.write_text(part.read_text() + "\n")
    (part.parent / f".{part.name}.crc").unlink()
    (tmp_path / "bundle" / "extra.txt").write_text("x")
    states = {r["state"] for r in intel.verified(sealed, intel.seal(spark, at)).collect()}
    assert {"changed", "added"} <= states
    with pytest.raises(ValueError, match="altered"):
        intel.read_bundle(spark, at)
    with pytest.raises(ValueError, match="not sealed"):
        intel.read_bundle(spark, str(tmp_path))


def test_custody(spark):
    rows, last = [], ""
    for k in range(1, 6):
        rows.append(intel.custody_entry(last, k, "seal", {"path": f"p{k % 2}", "sha256": str(k)}, "me", "now"))
        last = rows[-1]["hash"]
    frame = lambda r: spark.createDataFrame(r, "seq int, at string, actor string, action string, detail string, previous string, hash string")
    assert intel.custody_breaks(frame(rows)).count() == 0
    assert {(r["path"], r["sha256"]) for r in intel.newest_seals(frame(rows)).collect()} == {("p0", "4"), ("p1", "5")}
    forged = [*rows[:2], rows[2] | {"detail": "{}"}, *rows[3:]]
    assert [tuple(r) for r in intel.custody_breaks(frame(forged)).collect()] == [(3, "hash differs")]
    assert [r["reason"] for r in intel.custody_breaks(frame([*rows[:2], *rows[3:]])).collect()] == ["link broken"]


def test_lists_and_tags(spark, tmp_path):
    (tmp_path / "nodes.json").write_text(json.dumps({"1.2.3.4:8333": 1, "[2001:db8::1]:8333": 2, "abc.onion:8333": 3}))
    assert {r["ip"] for r in intel.node_list(spark, str(tmp_path / "nodes.json")).collect()} == {"1.2.3.4", "2001:db8::1", "abc.onion"}
    (tmp_path / "tor.txt").write_text("# exits\n1.1.1.1\n\n1.1.1.1\n")
    assert intel.host_list(spark, str(tmp_path / "tor.txt")).count() == 1
    (tmp_path / "watchlist.json").write_text('{"a": 0.5, "b": 1}')
    assert {tuple(r) for r in intel.watchlist(spark, str(tmp_path / "no"), str(tmp_path)).collect()} == {("a", 0.5), ("b", 1.0)}
    assert intel.watchlist(spark, str(tmp_path / "no")).count() == 0
    head = "address,label,category,confidence,applies_to,source,collected\n"
    (tmp_path / "t.csv").write_text(head + "x,L,mixer,0.5,address,s,2024\n")
    assert intel.tag_file(spark, str(tmp_path / "t.csv")).count() == 1
    (tmp_path / "bad.csv").write_text(head + "x,L,nothing,0.5,address,s,2024\n")
    with pytest.raises(ValueError, match="nothing"):
        intel.tag_file(spark, str(tmp_path / "bad.csv"))
    entry = lambda u, kind, name, t, a: f"<sdnEntry><uid>{u}</uid><lastName>{name}</lastName><sdnType>{kind}</sdnType><programList><program>CYBER</program></programList><idList><id><idType>{t}</idType><idNumber>{a}</idNumber></id></idList></sdnEntry>"
    xbt = "Digital Currency Address - XBT"
    (tmp_path / "sdn.xml").write_text(f'<sdnList xmlns="http://x">{entry(1, "Individual", "DOE", xbt, "a1")}{entry(2, "Entity", "SHOP", xbt, "a2")}{entry(3, "Entity", "SHOP", "Passport", "a3")}</sdnList>')
    assert {(r["address"], r["label"]) for r in intel.sanctions(spark, str(tmp_path / "sdn.xml"), "2024").collect()} == {("a1", "SDN 1 (CYBER)"), ("a2", "SHOP")}


def test_vantage():
    assert matrix.observer_of(["1.1.1.1"]) == ({"1.1.1.1"}, "explicit")
    assert matrix.observer_of(None, {"observer_local_ips": ["2.2.2.2"]})[1] == "label_file"
    with pytest.raises(matrix.VantageError):
        matrix.observer_of()
