"""Value traces, best paths, exit points and weighted taint against plain programs on random graphs."""

from __future__ import annotations

import heapq
import itertools
import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tracewright import plans
from tracewright.config import DEFAULT
from tracewright.operators import ledger, tracing
from tracewright.plans.adapters import Views

C = replace(DEFAULT, trace_hops=4, trace_share=0.02, trace_value=2.0)


def graph(seed, n=9, m=26):
    rng = random.Random(seed)
    found = {}
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        count = rng.randrange(1, 4)
        found[f"n{a}", f"n{b}"] = (float(rng.choice([1, 2, 2, 4, 8])), count, rng.choice([0, 0, 0, count - 1, count]))
    return found


def table(spark, g):
    return spark.createDataFrame([(a, b, *x) for (a, b), x in g.items()], "src string, dst string, value double, n long, mix_n long")


def names(spark, found, column="node"):
    return spark.createDataFrame([(x,) for x in found], f"{column} string")


def brute_trace(g, seed, stops, poison):
    into, out = defaultdict(float), defaultdict(float)
    for (a, b), (v, *_) in g.items():
        out[a] += v
        into[b] += v
    keep = lambda x: out[x] / max(into[x], out[x]) if out[x] else 0.0
    received, terminal, mixes, limit = defaultdict(float), defaultdict(float), {}, 0.0
    front, used = {seed: out[seed]}, set()
    for depth in range(C.trace_hops + 1):
        new = defaultdict(float)
        for x, amount in front.items():
            share = 1.0 if x == seed else keep(x)
            if x != seed:
                goes = x not in stops and depth < C.trace_hops and share > 0
                terminal[x] += amount * (1 - share) if goes else amount
                if not goes:
                    limit += amount * share if x not in stops and depth >= C.trace_hops else 0.0
                    continue
            for (a, b), (v, n, mix) in g.items():
                if a != x or b == seed:
                    continue
                carried = v if poison else amount * share * v / out[x]
                if mix >= n:
                    mixes.setdefault((a, b), (carried, depth + 1))
                elif not poison or (a, b) not in used:
                    used.add((a, b))
                    new[b] += carried
        front = {x: a for x, a in new.items() if a >= (C.trace_value if poison else C.trace_share * out[seed])}
        for x, a in front.items():
            received[x] += a
    return out[seed], received, terminal, mixes, limit


def brute_paths(g, seed, received, stops, poison, merge):
    out = defaultdict(float)
    for (a, _), (v, *_) in g.items():
        out[a] += v
    found = defaultdict(list)

    def go(path, conf, fraction):
        x = path[-1]
        if x != seed:
            found[x].append((-conf, len(path), path, fraction))
            if x in stops or not out[x]:
                return
        if len(path) > C.trace_hops:
            return
        for (a, b), (v, n, mix) in g.items():
            if a == x and b not in path and mix < n and b in received:
                f = 1.0 if poison else v / out[x]
                go([*path, b], conf * f * merge.get(b, 1.0), fraction * f)

    go([seed], 1.0, 1.0)
    return {x: sorted(p) for x, p in found.items()}


@pytest.mark.parametrize("poison", [False, True])
def test_trace_and_paths_of_many_seeds(spark, poison):
    # Graphs side by side under names of their own, so that one trace answers for all of them.
    g, stops, merge, seeds = {}, set(), {}, []
    for k in range(12):
        part = graph(k)
        g |= {(f"{k}{a}", f"{k}{b}"): x for (a, b), x in part.items()}
        rng = random.Random(-k)
        stops |= {f"{k}n{rng.randrange(9)}" for _ in range(2)}
        merge |= {f"{k}n{x}": rng.choice([0.5, 0.9]) for x in range(0, 9, 2)}
        seeds += [f"{k}n0", f"{k}n5"]
    e, s = table(spark, g), names(spark, [*seeds, seeds[0], "nobody"])
    t = tracing.trace(e, s, names(spark, stops), C, poison)
    got = {(r["seed"], r["node"]): (r["received"], r["terminal"]) for r in t.received.collect()}
    mixes = {(r["seed"], r["src"], r["dst"]): (r["value"], r["depth"]) for r in t.mixes.collect()}
    limit = {r["seed"]: r["amount"] for r in t.limit.collect()}
    paths = defaultdict(list)
    m = spark.createDataFrame(list(merge.items()), "node string, confidence double")
    for r in tracing.best_paths(e, t, m, names(spark, stops), C, poison).orderBy("rank").collect():
        paths[r["seed"], r["node"]].append((r["confidence"], len(r["path"]), r["path"], r["fraction"]))
    n = 0
    for seed in seeds:
        total, received, terminal, want_mixes, at_limit = brute_trace(g, seed, stops, poison)
        if not total:
            continue
        assert {x: got[s, x][0] for s, x in got if s == seed} == pytest.approx(dict(received))
        assert {x: got[s, x][1] for s, x in got if s == seed} == pytest.approx({x: terminal[x] for x in received})
        assert {k[1:]: v for k, v in mixes.items() if k[0] == seed} == {k: (pytest.approx(v), d) for k, (v, d) in want_mixes.items()}
        assert limit.get(seed, 0.0) == pytest.approx(at_limit)
        whole = brute_paths(g, seed, received, stops, poison, merge)
        want = {x: p[:3] for x, p in whole.items()}
        assert {x for s, x in paths if s == seed} == set(want)
        for x, rows in want.items():
            assert [(pytest.approx(-c), size) for c, size, *_ in rows] == [(c, size) for c, size, *_ in paths[seed, x]]
            every = {tuple(p): (-c, f) for c, _, p, f in whole[x]}
            assert all(every[tuple(p)] == (pytest.approx(c), pytest.approx(f)) for c, _, p, f in paths[seed, x])
            n += len(rows)
    assert n > 100 and (mixes or poison)


def test_mix_only_edges_stop_value(spark):
    e = table(spark, {("a", "b"): (10.0, 2, 2), ("b", "c"): (10.0, 1, 0)})
    t = tracing.trace(e, names(spark, ["a"]))
    assert t.received.count() == 0 and [tuple(r) for r in t.mixes.collect()] == [("a", "a", "b", 10.0, 1)]


def test_poison_counts_an_edge_once(spark):
    e = table(spark, {("a", "b"): (10.0, 1, 0), ("b", "c"): (4.0, 1, 0), ("c", "b"): (3.0, 1, 0)})
    t = tracing.trace(e, names(spark, ["a"]), c=replace(DEFAULT, trace_hops=5), poison=True)
    assert {r["node"]: r["received"] for r in t.received.collect()} == {"b": 13.0, "c": 4.0}


def test_no_edges_no_hops_no_seeds(spark):
    e = table(spark, {("a", "b"): (10.0, 1, 0)})
    two = replace(DEFAULT, trace_hops=2)
    for edges, seeds, c in ((e.limit(0), ["a"], two), (e, ["b"], two), (e, [], two), (e, ["a"], replace(two, trace_hops=0))):
        t = tracing.trace(edges, names(spark, seeds), c=c)
        assert t.received.count() + t.mixes.count() + t.limit.count() == 0
        if c.trace_hops:
            assert tracing.best_paths(edges, t, c=c).count() == 0
    assert tracing.exit_points(e, names(spark, []), names(spark, ["b"]), c=two).candidates.count() == 0


def test_exit_points_of_an_actor(spark):
    e = table(spark, {("a", "x"): (6.0, 1, 0), ("x", "v"): (3.0, 1, 0), ("a", "v"): (4.0, 1, 0), ("b", "w"): (1.0, 1, 0), ("v", "z"): (9.0, 1, 0)})
    actors = spark.createDataFrame([("A-1", "a"), ("A-1", "b"), ("A-2", "x")], "actor string, entity string")
    seeds = tracing.seeds_of("actor", "A-1", names(spark, []), actors)
    got = tracing.exit_points(e, seeds, names(spark, ["v"]), c=replace(DEFAULT, trace_hops=3))
    rows = {(r["seed"], r["node"]): (r["amount"], r["share"], round(r["confidence"], 6), round(r["score"], 6), r["rank"]) for r in got.candidates.collect()}
    assert rows == {("a", "v"): (7.0, 0.7, 0.6, 0.42, 1)}  # a-x-v: 0.6 * 1, a-v: 0.4; nothing goes on behind the service
    assert sorted((r["seed"], r["node"], r["share_kept"]) for r in got.sinks.collect()) == [("a", "x", 0.3), ("b", "w", 1.0)]
    members = spark.createDataFrame([("a1", "a")], "node string, component string")
    assert [tracing.seeds_of("address", x, members).first()[0] for x in ("a1", "q")] == ["a", "q"]
    with pytest.raises(ValueError, match="actor"):
        tracing.seeds_of("actor", "A-1", members)


def brute_taint(pairs, seeds, c, both):
    near = defaultdict(list)
    for (a, b), mixed in pairs.items():
        near[a].append((b, mixed))
        if both:
            near[b].append((a, mixed))
    queue = [(-w, 0, [s]) for s, w in seeds.items()]
    heapq.heapify(queue)
    best = {}
    while queue:
        s, hops, path = heapq.heappop(queue)
        if -s < c.taint_floor or path[-1] in best:
            continue
        best[path[-1]] = (-s, hops, path)
        if hops < c.taint_hops:
            for b in {b for b, mixed in near[path[-1]] if not mixed} - set(path):
                heapq.heappush(queue, (s * c.taint_decay, hops + 1, [*path, b]))
    return best


@pytest.mark.parametrize(("both", "seed"), list(itertools.product([False, True], range(2))))
def test_weighted_taint(spark, both, seed):
    g = graph(seed + 50, 14, 34)
    seeds = {"n0": 1.0, "n1": 0.1, "n2": 0.3, "lone": 0.7, "weak": 0.001}
    c = replace(DEFAULT, taint_hops=3)
    want = brute_taint({k: m >= n for k, (_, n, m) in g.items()}, seeds, c, both)
    got = tracing.weighted_taint(table(spark, g), spark.createDataFrame([*seeds.items(), ("n0", 0.2)], "node string, weight double"), c, both)
    assert {r["node"]: (r["score"], r["hops"], r["path"]) for r in got.collect()} == want


def test_weighted_taint_ends_where_labels_hang_on_each_other(spark):
    c = replace(DEFAULT, taint_hops=1)  # every other label ends the next one's, more often than there were rounds
    pairs = {(f"n{k}", f"n{k + 1}"): False for k in range(5)}
    seeds = {f"n{k}": w for k, w in enumerate((1.0, 0.4, 0.15, 0.06, 0.025, 0.0105))}
    edges = table(spark, {k: (1.0, 1, 0) for k in pairs})
    got = tracing.weighted_taint(edges, spark.createDataFrame([*seeds.items(), ("none", 0.0), ("nan", float("nan"))], "node string, weight double"), c)
    found = {r["node"]: (r["score"], r["hops"], r["path"]) for r in got.collect()}
    assert found == brute_taint(pairs, seeds, c, False) and found["n5"] == (0.0125, 1, ["n4", "n5"])
    with pytest.raises(ValueError, match="fade"):
        tracing.weighted_taint(edges, edges.selectExpr("src AS node", "1.0 AS weight"), replace(c, taint_decay=1.0))


def test_mixes_are_seen_from_neighbours(spark):
    rng = random.Random(7)
    rows = [(f"t{t}", k, rng.choice([None, 0.0, -1.0, *[100.0 * 1.012**j for j in range(9)]])) for t in range(300) for k in range(rng.randint(1, 9))]
    outs = spark.createDataFrame(rows, "txid string, idx int, value double")
    listed = outs.groupBy("txid").agg(ledger.equal_group(F.array_sort(F.collect_list("value")), 0.02)["n"].alias("n"))
    for least in (2, 3, 4):
        got = {r["txid"]: r["mix"] for r in ledger.in_mixes(outs, least).select("txid", "mix").distinct().collect()}
        want = {r["txid"]: bool((r["n"] or 0) >= least) for r in listed.collect()}
        assert got == want and set(want.values()) == {False, True}


def test_weighted_taint_over_all_orders(spark):
    sf = TESTDATA / "sf0.001"
    g = {(r["src"], r["dst"]): r["mix_n"] >= r["n"] for r in Views(spark, str(sf)).mixed.collect()}
    seeds = {f"A{r[0]}": 0.25 + r[0] % 4 * 0.25 for r in spark.read.parquet(str(sf / "supplier.parquet")).select("s_suppkey").collect()}
    want = brute_taint(g, seeds, replace(DEFAULT, taint_hops=3), False)
    got = {r["node"]: (r["score"], r["hops"], r["path"].split(">")) for r in plans.queries()["q_weighted_taint"](spark, str(sf)).collect()}
    assert got == want


def test_exits_need_no_paths(spark, monkeypatch):
    g = {}
    for k in range(2):
        g |= {(f"{k}{a}", f"{k}{b}"): x for (a, b), x in graph(k).items()}
    e, s, v = table(spark, g), names(spark, [f"{k}n0" for k in range(2)]), names(spark, [f"{k}n{x}" for k in range(2) for x in (3, 7)])
    c = replace(C, exit_sink=0.01, trace_hops=2)
    whole = tracing.exit_points(e, s, v, c=c)
    best = {("haircut", r["seed"], r["node"]): r["confidence"] for r in whole.paths.where("model = 'haircut' and rank = 1").collect()}
    sinks = {tuple(r) for r in tracing.exit_sinks(e, s, v, c).selectExpr("seed", "node", "round(kept, 9)", "round(poison_kept, 9)").collect()}
    assert sinks == {tuple(r) for r in whole.sinks.selectExpr("seed", "node", "round(kept, 9)", "round(poison_kept, 9)").collect()} != set()
    monkeypatch.setattr(tracing, "_walked", None)
    rows = tracing.exit_points(e, s, v, c=c).candidates.collect()
    assert rows and all(r["confidence"] == pytest.approx(best.get(("haircut", r["seed"], r["node"]), 0.0)) for r in rows)
