"""Actors: entities and the peers that announced for them, joined by links that may join, scored by the entities' own model.

A maximum spanning forest of the joining links holds, between any two members, the way whose weakest link is strongest. It is
found by Boruvka rounds (each component's heaviest link, then contraction by pointer doubling), and widths along it by
contracting the forest: leaves are raked, and of nodes with two neighbours those of locally least hash are bridged, so that a
chain of any length takes a logarithm of rounds. Each round is a few joins and aggregations, written to the shared folder.

Defined results: entities without links are actors of their own; links to entities without signals are left out; of repeated
links between one peer and one entity the strongest counts; ties are settled by the ends' names; null signals are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.metrics import placed
from tracewright.operators.scoring import stacked
from tracewright.session import written

#: Classes of hosts and bases of links that may join entities.
JOINING_CLASSES = ("residential_or_unknown", "residential")
JOINING_BASES = ("origination", "both")
ONION = "onion identity"


def may_join(peer_kind: Column, ip_class: Column, basis: Column, mixed: Column) -> Column:
    """Whether a link may put its entity into one actor with the peer's other entities."""
    own = (peer_kind == ONION) | ip_class.isin(*JOINING_CLASSES)
    return F.coalesce(own & basis.isin(*JOINING_BASES) & ~mixed, F.lit(False))


def _roots(pointers: DataFrame) -> DataFrame:
    """x, root for pointers (x, to) whose only cycles are pairs, by doubling; the lesser of a pair is its root."""
    back = pointers.select(F.col("x").alias("to"), F.col("to").alias("x"), F.lit(True).alias("pair"))
    now = pointers.join(back, ["x", "to"], "left")
    now = written(now.select("x", F.when(F.col("pair") & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("to")), "forest-pointers")
    while True:
        ahead = now.select(F.col("x").alias("to"), F.col("to").alias("next"))
        new = written(now.join(ahead, "to", "left").select("x", "to", F.coalesce("next", "to").alias("next")), "forest-pointers")
        if new.where("to <> next").isEmpty():
            return new.select("x", F.col("to").alias("root"))
        now = new.select("x", F.col("next").alias("to"))


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's links a, b, weight, and node, root of all nodes, for links (a, b, weight); the heavier, then lesser names win."""
    e = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    e = written(e.withColumns({"u": F.col("a"), "v": F.col("b")}), "forest-links")
    nodes = written(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "forest-nodes")
    found = None
    while not e.isEmpty():
        key = F.struct((-F.col("weight")).alias("w"), "a", "b")
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("d"), key.alias("k")).select("d.x", F.struct("k", "d.y").alias("s"))
        best = written(ends.groupBy("x").agg(F.min("s").alias("s")).select("x", F.col("s.y").alias("to"), "s.k.*"), "forest-best")
        taken = best.select("a", "b", (-F.col("w")).alias("weight")).distinct()
        found = taken if found is None else found.unionByName(taken)
        root = _roots(best.select("x", "to"))
        lifted = nodes.join(root.select(F.col("x").alias("root"), F.col("root").alias("r")), "root", "left")
        nodes = written(lifted.select("node", F.coalesce("r", "root").alias("root")), "forest-nodes")
        e = e.join(root.select(F.col("x").alias("u"), F.col("root").alias("ru")), "u").join(root.select(F.col("x").alias("v"), F.col("root").alias("rv")), "v")
        e = written(e.where("ru <> rv").select("a", "b", "weight", F.col("ru").alias("u"), F.col("rv").alias("v")), "forest-links")
    if found is None:
        found = e.select("a", "b", "weight")
    return written(found, "forest"), nodes


def forest_widths(forest: DataFrame, anchors: DataFrame) -> DataFrame:
    """node, width: the least weight on the forest's way from the one anchor (column node) of each tree; 1 at anchors."""
    tree = forest.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight")
    tree = written(tree.unionByName(tree.select(F.col("y").alias("x"), F.col("x").alias("y"), "weight")), "widths-tree")
    fixed = written(anchors.select(F.col("node").alias("x")).distinct(), "widths-anchors")
    steps: list[DataFrame] = []

    def without(t: DataFrame, gone: DataFrame) -> DataFrame:
        x = gone.select("x")
        return t.join(x, "x", "left_anti").join(x.withColumnRenamed("x", "y"), "y", "left_anti").select("x", "y", "weight")

    turn = 0
    while not tree.isEmpty():
        near = tree.groupBy("x").agg(F.count("*").alias("n"), F.min(F.struct("y", "weight")).alias("p"), F.max(F.struct("y", "weight")).alias("q"))
        near = written(near.join(fixed, "x", "left_anti").where("n <= 2"), "widths-near")
        leaves = near.where("n = 1").select("x", F.col("p.y").alias("p"), F.col("p.weight").alias("wp"), F.lit(None).cast(tree.schema["y"].dataType).alias("q"), F.lit(None).cast("double").alias("wq"))
        # Of two neighbours that could both be bridged, the one of lesser hash is; one beside a leaf waits for the next round.
        mine = F.struct(F.xxhash64("x", F.lit(turn)).alias("h"), "x")
        open_ = near.select("x", F.when(F.col("n") == 2, mine).alias("rank"), (F.col("n") == 1).alias("leaf"))
        both = near.where("n = 2").select("x", F.col("p.y").alias("p"), F.col("p.weight").alias("wp"), F.col("q.y").alias("q"), F.col("q.weight").alias("wq"), mine.alias("mine"))
        for side in ("p", "q"):
            other = open_.select(F.col("x").alias(side), F.col("rank").alias(f"r{side}"), F.col("leaf").alias(f"l{side}"))
            both = both.join(other, side, "left").where(f"not coalesce(l{side}, false) and (r{side} is null or mine < r{side})")
        gone = written(leaves.unionByName(both.select("x", "p", "wp", "q", "wq")), "widths-gone")
        steps.append(gone)
        bridge = gone.where("q is not null").select("p", "q", F.least("wp", "wq").alias("weight"))
        bridge = bridge.select(F.col("p").alias("x"), F.col("q").alias("y"), "weight").unionByName(bridge.select(F.col("q").alias("x"), F.col("p").alias("y"), "weight"))
        tree = written(without(tree, gone).unionByName(bridge), "widths-tree")
        turn += 1
    known = written(fixed.select(F.col("x").alias("node"), F.lit(1.0).alias("width")), "widths")
    for gone in reversed(steps):
        way = [known.select(F.col("node").alias(s), F.col("width").alias(f"k{s}")) for s in ("p", "q")]
        # The anchor lies behind one of the two: the way over the other is no wider.
        new = gone.join(way[0], "p").join(way[1], "q", "left").select(F.col("x").alias("node"), F.greatest(F.least("wp", "kp"), F.least("wq", "kq")).alias("width"))
        known = written(known.unionByName(new), "widths")
    return known


def actors(signals: DataFrame, links: DataFrame, weights: dict[str, float], intercept: float, threshold: float = 0.5) -> DataFrame:
    """One row an actor: actor, anchor, members, peers, risk, membership, alerted, and its signals s_NAME.

    signals: entity and a column for each weight. links: peer, entity, confidence, peer_kind, ip_class, basis, and mixed (an
    origin claim behind it goes through a CoinJoin; such links count for nothing). Every other link counts for the
    membership confidence, which is the weakest of the members' links; those that may join make the actors. The anchor is
    the member of highest risk. A signal is the members' largest, each weighted by its width from the anchor; the same
    model scores the actor. Names A-1, A-2, ... follow the least member, so that another order of risk renames none.
    """
    return members_of(signals, links, weights, intercept, threshold)[0]


def members_of(signals: DataFrame, links: DataFrame, weights: dict[str, float], intercept: float, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """actors(), and actor, entity, risk, width of every member."""
    own = stacked(signals.select("entity", *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in weights]), weights, intercept)
    own = written(own, "actor-signals")
    held = links.where(~F.coalesce("mixed", F.lit(False))).join(own.select("entity"), "entity", "left_semi")
    held = written(held.withColumn("joins", may_join(F.col("peer_kind"), F.col("ip_class"), F.col("basis"), F.lit(False))), "actor-links")
    name = {"entity": F.concat(F.lit("e:"), "entity"), "peer": F.concat(F.lit("p:"), "peer")}
    forest, nodes = spanning_forest(held.where("joins").select(name["peer"].alias("a"), name["entity"].alias("b"), F.col("confidence").cast("double").alias("weight")))
    rows = own.withColumn("node", name["entity"]).join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    anchor = rows.groupBy("root").agg(F.max(F.struct("risk", "entity", "node")).alias("top"), F.min("entity").alias("least"))
    anchor = placed(anchor.select("root", F.col("top.entity").alias("anchor"), F.col("top.node").alias("node"), "least"), [F.col("least").asc()])
    anchor = anchor.withColumn("actor", F.concat(F.lit("A-"), F.col("place").cast("string")))
    width = forest_widths(forest, anchor.select("node").join(nodes.select("node"), "node", "left_semi"))
    rows = rows.join(width, "node", "left").withColumn("width", F.coalesce("width", F.lit(1.0)))
    rows = written(rows.join(anchor.select("root", "actor", "anchor"), "root").select("actor", "anchor", "entity", "risk", "width", *weights), "actor-members")
    beside = held.join(rows.select("entity", "actor"), "entity").groupBy("actor").agg(F.countDistinct("peer").alias("peers"), F.min("confidence").alias("membership"))
    out = rows.groupBy("actor", "anchor").agg(F.count("*").alias("members"), *[F.max(F.col(k) * F.col("width")).alias(k) for k in weights])
    out = stacked(out, weights, intercept).join(beside, "actor", "left")
    out = out.select("actor", "anchor", "members", F.coalesce("peers", F.lit(0)).alias("peers"), "risk", F.coalesce("membership", F.lit(1.0)).alias("membership"), (F.col("risk") >= threshold).alias("alerted"), *[F.col(k).alias(f"s_{k}") for k in weights])
    return out, rows.select("actor", "entity", "risk", "width")
