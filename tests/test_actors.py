"""Actors against Kruskal's algorithm and plain walks."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from tracewright.operators import actors

WEIGHTS, BIAS = {"rules": 2.0, "taint": 1.0}, -1.0


def kruskal(links):
    parent, tree = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted({(-w, min(a, b), max(a, b)) for a, b, w in links if a != b}):
        a_, b_ = find(a), find(b)
        if a_ != b_:
            parent[a_] = b_
            tree.append((a, b, -w))
    return tree, {x: find(x) for x in list(parent)}


def widths(tree, anchor):
    near = defaultdict(list)
    for a, b, w in tree:
        near[a].append((b, w))
        near[b].append((a, w))
    out, todo = {anchor: 1.0}, [anchor]
    for x in todo:
        for y, w in near[x]:
            if y not in out:
                out[y] = min(out[x], w)
                todo.append(y)
    return out


def test_forest_and_widths(spark):
    rng = random.Random(2)
    links = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}", rng.choice([0.1, 0.3, 0.3, 0.5, 0.9])) for _ in range(170)]
    links += [(f"c{k:03}", f"c{k + 1:03}", rng.random()) for k in range(300)]  # a chain
    links += [("hub", f"h{k}", 0.5) for k in range(60)]
    forest, nodes = actors.spanning_forest(spark.createDataFrame(links, "a string, b string, weight double"))
    tree, root = kruskal(links)
    assert sorted((min(r[0], r[1]), max(r[0], r[1]), r[2]) for r in forest.collect()) == sorted((min(a, b), max(a, b), w) for a, b, w in tree)
    groups, mine = defaultdict(set), defaultdict(set)
    for x, r in root.items():
        groups[r].add(x)
    for r in nodes.collect():
        mine[r["root"]].add(r["node"])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    anchors = [rng.choice(sorted(g)) for g in groups.values()]
    got = {r["node"]: r["width"] for r in actors.forest_widths(forest, spark.createDataFrame([(a,) for a in anchors], "node string")).collect()}
    assert got == {x: w for a in anchors for x, w in widths(tree, a).items()}


def test_actors_of_mixed_links(spark):
    rng = random.Random(5)
    signals = [(f"e{k:02}", rng.choice([None, round(rng.random(), 3)]), round(rng.random(), 3)) for k in range(40)]
    links = []
    for _ in range(160):
        kind, ip_class = rng.choice([("IP", "residential"), ("IP", "hosting"), ("onion identity", None), ("IP", None)])
        links.append((f"p{rng.randrange(12)}", f"e{rng.randrange(44):02}", rng.choice([0.2, 0.4, 0.4, 0.8]), kind, ip_class, rng.choice(["origination", "both", "correlation", None]), rng.choice([False, False, False, True, None])))
    df = spark.createDataFrame(signals, "entity string, rules double, taint double")
    out, members = actors.members_of(df, spark.createDataFrame(links, "peer string, entity string, confidence double, peer_kind string, ip_class string, basis string, mixed boolean"), WEIGHTS, BIAS)
    score = lambda r, t: 1 / (1 + math.exp(-(2.0 * r + t - 1.0)))
    value = {e: (r or 0.0, t) for e, r, t in signals}
    held = [x for x in links if x[1] in value and not x[6]]
    joins = [x for x in held if (x[3] == "onion identity" or x[4] == "residential") and x[5] in ("origination", "both")]
    tree, root = kruskal([("p:" + p, "e:" + e, c) for p, e, c, *_ in joins])
    groups = defaultdict(list)
    for e in value:
        groups[root.get("e:" + e, "e:" + e)].append(e)
    want = {}
    for n, mine in enumerate(sorted(sorted(g) for g in groups.values()), 1):
        anchor = max(mine, key=lambda e: (score(*value[e]), e))
        w = widths(tree, "e:" + anchor)
        top = [max(value[e][k] * w["e:" + e] for e in mine) for k in range(2)]
        beside = [x for x in held if x[1] in mine]
        want[f"A-{n}"] = (anchor, len(mine), len({x[0] for x in beside}), pytest.approx(score(*top)), min((x[2] for x in beside), default=1.0), score(*top) >= 0.5)
    got = {r["actor"]: (r["anchor"], r["members"], r["peers"], r["risk"], r["membership"], r["alerted"]) for r in out.collect()}
    assert got == want and max(x[1] for x in want.values()) > 2
    assert members.count() == 40


def test_without_links_or_signals(spark):
    signals = spark.createDataFrame([("a", 1.0, 0.0)], "entity string, rules double, taint double")
    links = spark.createDataFrame([("p", "zz", 0.5, "IP", "residential", "both", False)], "peer string, entity string, confidence double, peer_kind string, ip_class string, basis string, mixed boolean")
    row = actors.actors(signals, links, WEIGHTS, BIAS).first()
    assert (row["actor"], row["anchor"], row["members"], row["peers"], row["membership"]) == ("A-1", "a", 1, 0, 1.0)
    assert actors.actors(signals.limit(0), links, WEIGHTS, BIAS).count() == 0
