"""Graph queries without SQL, over all orders, against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.conftest import TESTDATA
from tracewright import plans
from tracewright.operators import paths
from tracewright.plans.adapters import Views

SF = TESTDATA / "sf0.001"
def _graph():
    rows = duckdb.sql(f"""SELECT 'A' || o_custkey, 'A' || l_partkey, sum(l_extendedprice * (1 - l_discount)) FROM '{SF}/orders.parquet'
        JOIN '{SF}/lineitem.parquet' ON o_orderkey = l_orderkey GROUP BY 1, 2""").fetchall()
    return {(a, b): v for a, b, v in rows if a != b}


def test_trace_paths_over_all_orders(spark):
    g = _graph()
    out, total = defaultdict(list), Counter()
    for (a, b), v in g.items():
        out[a].append(b)
        total[a] += v
    seed = min(a for a, _ in g)
    best, front = Counter(), [((seed,), 1.0)]
    for _ in range(3):
        front = [((*p, b), c * g[p[-1], b] / total[p[-1]]) for p, c in front for b in out[p[-1]] if b not in p]
        for p, c in front:
            best[p[-1]] = max(best[p[-1]], c)
    got = {r["node"]: r["confidence"] for r in plans.queries()["q_trace_paths"](spark, str(SF)).where("rank = 1").collect()}
    assert got == pytest.approx(best, abs=1e-7)


def test_peel_chains_of_any_length_and_into_cycles(spark):
    rng = random.Random(3)
    nxt = {f"a{k}": f"a{k + 1}" for k in range(150)} | {f"c{k}": f"c{(k + 1) % 7}" for k in range(7)} | {f"t{k}": f"t{k + 1}" for k in range(4)} | {"t4": "c3", "d0": "d1", "d1": "d0"}
    nxt |= {f"r{k}": f"r{rng.randrange(80)}" for k in range(60)}
    nxt = {a: b for a, b in nxt.items() if a != b}
    want = {}
    for head in set(nxt) - set(nxt.values()):
        seen, at = {head}, head
        while at in nxt and nxt[at] not in seen:
            at = nxt[at]
            seen.add(at)
        want[head] = len(seen) - 1
    got = {r["head"]: r["hops"] for r in paths.peel_chains(spark.createDataFrame(list(nxt.items()), "txid string, next string"), 1).collect()}
    assert (want["a0"], want["t0"]) == (150, 11)
    assert got == want


def test_long_chain_is_in_the_query(spark, tmp_path):
    """A chain of 70 hops: order k pays its larger output to the customer of order k + 1."""
    n = 72
    orders = [(k, k, f"1995-01-01 00:00:{k % 60:02d}") for k in range(1, n)]
    lines = [(k, line, k + 1 if line == 1 else 10**6, 100.0 if line == 1 else 10.0, 0.0) for k in range(1, n) for line in (1, 2)]
    df = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string")
    df.selectExpr("o_orderkey", "o_custkey", "cast(d as timestamp) as o_orderdate", "100.0d as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert Views(spark, str(tmp_path)).orders.count() == n - 1
    assert [tuple(r) for r in plans.queries()["q_peel_chains"](spark, str(tmp_path)).collect()] == [("T1", 70)]
