"""Graph operators: reach, taint, shortest path, widest path, peel walks, layering, message passing.

One kernel serves them: a frontier that joins the edge table once a round, keeps its best row per node, and is cut to the
shared folder each round. Hubs are never gathered; each round is a join and a partial aggregation.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.config import DEFAULT, Config
from tracewright.operators import tracing
from tracewright.session import written


def reach(edges: DataFrame, seeds: DataFrame, hops: int, undirected: bool = False) -> DataFrame:
    """node, hop: nodes within this many hops of the seeds (column node), with the fewest hops."""
    e = edges.select("src", "dst").distinct()
    if undirected:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = written(e, "edges")
    seen = written(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "reach")
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(new.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def taint(edges: DataFrame, seeds: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """node, score, hops, path: decay per hop from seeds of equal weight; edges that only mixes made are not crossed.

    The least path wins ties, so every node has one label, and expands once.
    """
    e = written(edges.where("mix_n < n").select("src", "dst").distinct(), "edges")
    seen = written(seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.array("node").alias("path")), "taint")
    front, score = seen, 1.0
    for hop in range(1, c.taint_hops + 1):
        score *= c.taint_decay
        if score < c.taint_floor:
            break
        new = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = new.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        front = written(new.select("node", F.lit(hop).alias("hops"), "path"), "taint")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select("node", F.pow(F.lit(c.taint_decay), "hops").alias("score"), "hops", "path")


def trace(edges: DataFrame, seed: str, hops: int, share: float = 0.001, poison: bool = False) -> DataFrame:
    """node, received, terminal: value followed from one seed (tracing.trace, which takes many)."""
    c = replace(DEFAULT, trace_hops=hops, trace_share=share, trace_value=share)
    seeds = edges.sparkSession.createDataFrame([(seed,)], "node string")
    return tracing.trace(edges, seeds, c=c, poison=poison).received.drop("seed")


def trace_paths(edges: DataFrame, seed: str, hops: int, k: int = 3) -> DataFrame:
    """node, path, confidence, rank: the k best simple paths from one seed to each node, by the product of edge shares."""
    c = replace(DEFAULT, trace_hops=hops, trace_share=0.0)
    traced = tracing.trace(edges, edges.sparkSession.createDataFrame([(seed,)], "node string"), c=c)
    return tracing.best_paths(edges, traced, c=c, k=k).select("node", "path", "confidence", "rank")


def shortest_path(edges: DataFrame, start: str, goal: str, hops: int = 30) -> DataFrame:
    """step, node of a shortest directed path; the least parent wins at each node. No rows without a path."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    spark = e.sparkSession
    seen = front = spark.createDataFrame([(start, None, 0)], "node string, parent string, hop int")
    for hop in range(1, hops + 1):
        new = front.join(e, front["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = written(new.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "path")
        if front.isEmpty():
            return spark.createDataFrame([], "step int, node string")
        seen = seen.unionByName(front)
        if not front.where(F.col("node") == goal).isEmpty():
            break
    back = seen.where(F.col("node") == goal)
    found = back.select(F.col("hop").alias("step"), "node", "parent")
    for _ in range(hops):
        back = written(found.groupBy().agg(F.min_by("parent", "step").alias("want")).join(seen, F.col("want") == F.col("node")).select(F.col("hop").alias("step"), "node", "parent"), "path")
        if back.isEmpty():
            break
        found = found.unionByName(back)
    return found.select("step", "node")


def widest(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """node, width: the largest least weight on a way from any anchor (column node); edges (a, b, weight) go both ways."""
    e = edges.select("a", "b", "weight")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "edges")
    now = written(anchors.select("node").distinct().withColumn("width", F.lit(1.0)), "widest")
    state = None
    while True:
        step = now.join(e, now["node"] == e["a"]).select(F.col("b").alias("node"), F.least("width", "weight").alias("width"))
        now = written(now.unionByName(step).groupBy("node").agg(F.max("width").alias("width")), "widest")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "width").cast("decimal(38,0)"))).first())
        if seen == state:
            return now
        state = seen


def wallet_trace(ins: DataFrame, outs: DataFrame, seeds: DataFrame, hops: int, least: float = 0.0, forward: bool = True) -> DataFrame:
    """node, hop, pruned: wallets reached from the seeds (column node) through transactions, by outputs of at least an amount.

    pruned counts the outputs that a reached wallet's transactions had under it. Backward swaps the sides.
    """
    a, b = (ins, outs) if forward else (outs, ins)
    paid = a.select("txid", F.col("addr").alias("src")).join(b.select("txid", F.col("addr").alias("dst"), "value"), "txid")
    small = paid.where(F.col("value") < least).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    seen = reach(paid.where(F.col("value") >= least), seeds, hops)
    rows = seen.join(small, "node", "left")
    return rows.select("node", "hop", F.when(F.col("hop") < hops, F.coalesce("n", F.lit(0))).otherwise(0).alias("pruned"))


def peel_links(features: DataFrame, outs: DataFrame, spender: DataFrame, ratio: float = DEFAULT.peel_ratio) -> DataFrame:
    """txid, next: both peel-shaped, next being the first spender of the larger output (the first one on ties)."""
    peels = features.where((F.col("n_in") == 1) & (F.col("n_out") == 2) & (F.col("peel_ratio") <= ratio)).select("txid")
    peels = written(peels, "peels")  # both ends of a link ask for them
    larger = outs.join(peels, "txid", "left_semi").groupBy("txid").agg(F.max_by("addr", F.struct("value", -F.col("idx"))).alias("addr"))
    follow = larger.join(spender.select("addr", F.col("txid").alias("next")), "addr")
    return follow.join(peels.withColumnRenamed("txid", "next"), "next", "left_semi").where("txid <> next").select("txid", "next")


def peel_chains(links: DataFrame, least: int) -> DataFrame:
    """head, hops: chains of a successor table that nothing continues into, by pointer doubling. Cycles have no head.

    A chain that runs into a cycle ends before the first transaction that it meets again.
    """
    links = written(links.select("txid", "next"), "peel-links")
    jump, ring = _jumps(links)
    if ring is not None:
        sizes = _ring_sizes(links.join(ring, "txid", "left_semi"))
        jump, _ = _jumps(links.join(ring, "txid", "left_anti"))
        jump = jump.join(sizes.withColumnRenamed("txid", "to"), "to", "left").withColumn("n", F.col("n") + F.coalesce(F.col("size") - 1, F.lit(0)))
    heads = jump.join(links.select(F.col("next").alias("txid")).distinct(), "txid", "left_anti")
    return heads.where(F.col("n") >= least).select(F.col("txid").alias("head"), F.col("n").alias("hops"))


def walk_lengths(links: DataFrame) -> DataFrame:
    """txid, hops: how many links follow a transaction; those that run into a cycle are left out."""
    jump, ring = _jumps(links)
    if ring is not None:
        jump = jump.join(ring.withColumnRenamed("txid", "to"), "to", "left_anti")
    return jump.select("txid", F.col("n").alias("hops"))


def _jumps(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """txid, to, n: where each chain ends and after how many links; and the transactions on cycles, if there are any."""
    jump = written(links.select("txid", F.col("next").alias("to"), F.lit(1).cast("long").alias("n")), "peel")
    total, far = jump.count(), 1
    while True:
        ahead = jump.select(F.col("txid").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        new = written(jump.join(ahead, "to", "left"), "peel")
        if new.where("to2 is not null").isEmpty():
            return jump, None
        if far >= total:  # what still moves after as many steps as there are links is on a cycle
            return jump, written(new.where("to2 is not null").select(F.col("to").alias("txid")).distinct(), "peel")
        jump = new.select("txid", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        far *= 2


def _ring_sizes(ring: DataFrame) -> DataFrame:
    """txid, size of the cycle it is on, for links that are all on cycles."""
    now = written(ring.select("txid", F.col("next").alias("to"), F.col("txid").alias("low")), "peel")
    total, far = now.count(), 1
    while far < total:
        ahead = now.select(F.col("txid").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        now = written(now.join(ahead, "to").select("txid", F.col("to2").alias("to"), F.least("low", "low2").alias("low")), "peel")
        far *= 2
    return now.join(now.groupBy("low").agg(F.count("*").alias("size")), "low").select("txid", "size")


def layering(txs: DataFrame, features: DataFrame, ins: DataFrame, outs: DataFrame, spender: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """split, merge, hops, traced: a split's value comes together again in a merge, in time and within the hops."""
    plain = written(features.where("not coinjoin").select("txid", "ts", "n_in", "n_out"), "layering-features")
    splits = plain.where(F.col("n_out") >= c.layering_outs).select(F.col("txid").alias("split"), F.col("ts").alias("t0"))
    merges = plain.where(F.col("n_in") >= c.layering_ins).select(F.col("txid").alias("merge"))
    follow = outs.join(spender.select("addr", F.col("txid").alias("to"), F.col("ts").alias("to_ts")), "addr").where("txid <> `to`").select("txid", "to", "to_ts")  # what repeats meets the next round's distinct
    follow = written(follow, "follow")
    seen = written(splits.select("split", "t0", F.col("split").alias("txid"), F.lit(0).alias("hop")), "layering")
    front = seen
    for hop in range(1, c.layering_hops + 1):
        new = front.join(follow, "txid").where(F.col("to_ts") - F.col("t0") <= c.layering_hours * 3600)
        new = new.select("split", "t0", F.col("to").alias("txid")).distinct().join(seen, ["split", "txid"], "left_anti")
        front = written(new.select("split", "t0", "txid", F.lit(hop).alias("hop")), "layering")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    hits = seen.where("hop > 0").join(merges, F.col("txid") == F.col("merge")).select("split", "merge", F.col("hop").alias("hops"))
    held = seen.join(outs.select("txid", "addr"), "txid").select("split", "addr").distinct()
    parts = int(ins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = hits.join(ins.select(F.col("txid").alias("merge"), "addr").repartition(parts, "merge").distinct(), "merge")
    need = need.join(held.withColumn("hit", F.lit(1.0)), ["split", "addr"], "left")
    rows = need.groupBy("split", "merge", "hops").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("traced"))
    return rows.where(F.col("traced") >= c.layering_traced)


def messages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One round of message passing: per target the sum of relu(x[src] + e), element by element."""
    rows = edges.join(nodes.select(F.col("node").alias("src"), "x"), "src")
    rows = rows.select("dst", F.posexplode(F.zip_with("x", "e", lambda a, b: F.greatest(a + b, F.lit(0.0)))).alias("k", "m"))
    return rows.groupBy("dst", "k").agg(F.sum("m").alias("m"))
