"""Announcements: window statistics, strictly earlier peer history, origin estimators, validity verdicts.

``hops(txid, src, dst, ts)`` are propagation hops; ``seen(txid, peer, ts)`` are announcements to one vantage.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT, Config
from tracewright.functions.metrics import quantiles
from tracewright.session import written


def announcement_stats(seen: DataFrame) -> DataFrame:
    """Per announcement: rank (ties share), is_first, delta to the first and to the median, z, span of the transaction."""
    tx = Window.partitionBy("txid")
    rank = F.rank().over(tx.orderBy("ts"))
    sd = F.coalesce(F.stddev_samp("ts").over(tx), F.lit(0.0))
    return seen.select(
        "txid", "peer", "ts", rank.alias("rank"), (rank == 1).alias("is_first"),
        (F.col("ts") - F.min("ts").over(tx)).alias("delta_first"),
        (F.col("ts") - F.median("ts").over(tx)).alias("delta_median"),
        F.when(sd > 0, (F.col("ts") - F.avg("ts").over(tx)) / sd).otherwise(0.0).alias("z"),
        (F.max("ts").over(tx) - F.min("ts").over(tx)).alias("span"),
    )


def running_medians(rows: DataFrame, key: str) -> DataFrame:
    """key, at, median: of the values at earlier places of a key; rows: key, at (a place of its own in the key), value (or null).

    Order statistics by descent: a key's values are numbered in order, and each question goes down the bits of that number,
    counting in each round how many earlier values share its prefix and go left. A round is one window of running counts,
    and there are as many as the largest key's values have bits; no row ever holds a list of what was before.
    """
    elements = rows.where("value is not null").withColumn("leaf", F.row_number().over(Window.partitionBy(key).orderBy("value", "at")) - 1)
    elements = written(elements.select(key, "at", "value", "leaf"), "medians")
    top = elements.agg(F.max("leaf")).first()[0] or 0
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    asked = rows.select(key, "at", F.count("value").over(before).alias("n")).where("n > 0")
    asked = asked.select(key, "at", F.lit(0).alias("node"), F.explode(F.array(F.struct(F.lit(1).alias("which"), F.floor((F.col("n") + 1) / 2).alias("k")), F.struct(F.lit(2).alias("which"), (F.floor(F.col("n") / 2) + 1).alias("k")))).alias("q"))
    asked = asked.select(key, "at", "node", "q.which", "q.k")
    for b in reversed(range(max(1, int(top).bit_length()))):
        left = (F.shiftright("leaf", b).bitwiseAND(F.lit(1)) == 0).cast("long")
        held = elements.select(key, "at", F.shiftright("leaf", b + 1).alias("node"), F.lit(0).alias("which"), F.lit(0).cast("long").alias("k"), F.lit(1).alias("held"), left.alias("left"))
        both = held.unionByName(asked.select("*", F.lit(0).alias("held"), F.lit(0).cast("long").alias("left")))
        earlier = Window.partitionBy(key, "node").orderBy("at", "held").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("lefts", F.coalesce(F.sum("left").over(earlier), F.lit(0))).where("held = 0")
        goes = F.col("k") <= F.col("lefts")
        asked = both.select(key, "at", F.when(goes, F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node"), "which", F.when(goes, F.col("k")).otherwise(F.col("k") - F.col("lefts")).alias("k"))
    found = asked.join(elements.select(key, F.col("leaf").alias("node"), "value"), [key, "node"])
    return found.groupBy(key, "at").agg(F.avg("value").alias("median"))


def earlier(first: DataFrame, tx: tuple[str, ...] = ("txid",), peer: tuple[str, ...] = ("peer",)) -> DataFrame:
    """first, one row a transaction and peer (by these keys, the last of which orders), with what was known of the peer strictly
    before: all of peer_history but the median; and at, value: the row's place among the peer's, the gap that it closes."""
    opened = F.row_number().over(Window.partitionBy(*tx).orderBy("ts", peer[-1])) == 1
    w = Window.partitionBy(*peer).orderBy("ts", tx[-1])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = first.withColumn("opened", opened.cast("int")).withColumns({"value": F.col("ts") - F.lag("ts").over(w), "at": F.row_number().over(w), "elapsed": F.col("ts") - F.first("ts").over(w)})
    n = F.col("at") - 1
    rows = rows.withColumns({
        "txids_before": n, "firsts_before": F.coalesce(F.sum("opened").over(before), F.lit(0)), "gap_mean": F.avg("value").over(before),
        "gap_sd": F.when(n == 2, 0.0).otherwise(F.stddev_samp("value").over(before)), "rate": F.when(F.col("elapsed") > 0, n / (F.col("elapsed") / 60.0)), "age": F.when(n > 0, F.col("elapsed")),
    })
    return rows.withColumn("first_share", F.when(n > 0, F.col("firsts_before") / n)).drop("opened", "elapsed")


def peer_history(seen: DataFrame) -> DataFrame:
    """What was known of a peer strictly before each announcement: transactions, firsts and their share, gap mean, median and
    deviation, announcements a minute, and seconds since its first."""
    rows = written(earlier(seen.groupBy("txid", "peer").agg(F.min("ts").alias("ts"))), "history")
    rows = rows.join(running_medians(rows.select("peer", "at", "value"), "peer"), ["peer", "at"], "left")
    return rows.select("txid", "peer", "txids_before", "firsts_before", "gap_mean", F.col("median").alias("gap_median"), "gap_sd", "rate", "age", "first_share")


def relatives(scores: DataFrame) -> DataFrame:
    """Within a transaction: lead over the next announcer, gap to the best score, normalised share, rank."""
    tx = Window.partitionBy("txid")
    return scores.select(
        "txid", "peer",
        (F.lead("delta").over(tx.orderBy("delta", "peer")) - F.col("delta")).alias("lead"),
        (F.col("score") - F.max("score").over(tx)).alias("gap_to_best"),
        (F.col("score") / F.greatest(F.lit(1.0), F.sum("score").over(tx))).alias("share"),
        F.row_number().over(tx.orderBy(F.col("score").desc(), "peer")).alias("place"),
    )


def tree_nodes(hops: DataFrame) -> DataFrame:
    """txid, ip, first_seen, first_sent: when a node was first on either end, and first sent."""
    ends = hops.select("txid", F.col("src").alias("ip"), "ts", F.col("ts").alias("sent")).unionByName(
        hops.select("txid", F.col("dst").alias("ip"), "ts", F.lit(None).cast("double").alias("sent"))
    )
    return ends.groupBy("txid", "ip").agg(F.min("ts").alias("first_seen"), F.min("sent").alias("first_sent"))


def first_timestamp(nodes: DataFrame) -> DataFrame:
    """txid, ip, place, score = (n - i) / n in order of first sight; senders come before those who only received then."""
    tx = Window.partitionBy("txid")
    sender = F.when(F.col("first_sent") == F.col("first_seen"), 0).otherwise(1)
    place = F.row_number().over(tx.orderBy("first_seen", sender, "ip")) - 1
    n = F.count("*").over(tx)
    return nodes.select("txid", "ip", place.alias("place"), ((n - place) / n).alias("score"))


def origins(scores: DataFrame, observations: DataFrame, classes: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One origin a transaction: the best class-weighted score, its confidence, and what limits it.

    observations: txid, n. classes: ip, ip_class.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in c.class_weights.items() for x in kv]), F.col("ip_class")), F.lit(1.0))
    tx = Window.partitionBy("txid")
    rows = scores.join(classes, "ip", "left").withColumn("ip_class", F.coalesce("ip_class", F.lit("residential")))
    rows = rows.withColumn("w", F.col("score") * weight).withColumn("n_nodes", F.count("*").over(tx))
    rows = rows.withColumn("total", F.sum("w").over(tx)).withColumn("rank", F.row_number().over(tx.orderBy(F.col("w").desc(), "ip")))
    best = rows.where(F.col("rank") == 1).join(observations, "txid")
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w") / F.col("total") * (1 - F.exp(-F.col("n") / 3.0))))
    sure = F.when((F.col("n") <= 1) | (F.col("n_nodes") <= 1), c.single_row_confidence).otherwise(sure)
    best = best.withColumn("confidence", sure)
    masked = F.col("ip_class").isin("tor", "hosting")
    return best.select(
        "txid", "ip", "ip_class", "n_nodes", "n", "confidence",
        ((F.col("ip_class") == "relay") | (F.col("confidence") < c.low_confidence)).alias("low_confidence"),
        (F.col("confidence") * F.when(masked, c.masked_discount).otherwise(1.0)).alias("attribution"),
    )


def _rumor(rows: pd.DataFrame) -> pd.DataFrame:
    """Log rumor centrality of each node of one transaction's spanning tree, shares summing to one."""
    import math

    txid = rows["txid"].iloc[0]
    first: dict[str, float] = {}
    near: dict[str, set[str]] = {}
    for s, d, t in zip(rows["src"], rows["dst"], rows["ts"], strict=True):
        for x in (s, d):
            first[x] = min(first.get(x, t), t)
            near.setdefault(x, set())
        if s != d:
            near[s].add(d)
            near[d].add(s)
    root = min(first, key=lambda x: (first[x], x))
    parent, order = {root: None}, [root]
    for x in order:
        for y in sorted(near[x], key=lambda y: (first[y], y)):
            if y not in parent:
                parent[y] = x
                order.append(y)
    size = dict.fromkeys(order, 1)
    for x in reversed(order[1:]):
        size[parent[x]] += size[x]
    n = len(order)
    log = {root: math.lgamma(n + 1) - sum(math.log(size[x]) for x in order)}
    for x in order[1:]:  # moving the root across an edge changes two subtree sizes
        log[x] = log[parent[x]] + math.log(size[x]) - math.log(n - size[x])
    top = max(log.values())
    total = sum(math.exp(v - top) for v in log.values())
    return pd.DataFrame({"txid": txid, "ip": order, "score": [math.exp(log[x] - top) / total for x in order]})


def rumor_centrality(hops: DataFrame) -> DataFrame:
    """txid, ip, score. A transaction's tree is a few dozen nodes: edges are first cut to the earliest of each pair."""
    edges = hops.groupBy("txid", "src", "dst").agg(F.min("ts").alias("ts"))
    return edges.groupBy("txid").applyInPandas(_rumor, "txid string, ip string, score double")


def blended(first: DataFrame, rumor: DataFrame, share: float = 0.6) -> DataFrame:
    """The timestamp-weighted estimator: share of the first-timestamp score and the rest of the rumor score."""
    r = rumor.select("txid", "ip", F.col("score").alias("r"))
    return first.join(r, ["txid", "ip"], "left").select("txid", "ip", (share * F.col("score") + (1 - share) * F.coalesce("r", F.lit(0.0))).alias("score"))


def isolation(seen: DataFrame) -> DataFrame:
    """txid, first_gap, later_gap (median), ratio: a first announcement far ahead of the rest hints at a stem."""
    w = Window.partitionBy("txid").orderBy("ts", "peer")
    rows = seen.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).withColumn("rn", F.row_number().over(w))
    return rows.groupBy("txid").agg(
        F.max(F.when(F.col("rn") == 2, F.col("gap"))).alias("first_gap"), F.median(F.when(F.col("rn") > 2, F.col("gap"))).alias("later_gap")
    )


def noise_floor(hops: DataFrame) -> DataFrame:
    """Gaps between consecutive first sights by different senders: n and percentiles 10, 50, 90."""
    firsts = hops.groupBy("txid", "src").agg(F.min("ts").alias("ts"))
    gaps = firsts.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("txid").orderBy("ts", "src"))).where("gap is not null")
    gaps = written(gaps.select("gap"), "gaps")
    p = quantiles(gaps, "gap", [0.1, 0.5, 0.9])
    return gaps.agg(F.count("*").alias("n"), *[F.lit(x).cast("double").alias(k) for k, x in zip(("p10", "p50", "p90"), p, strict=True)])


def timing_signature(seen: DataFrame, least: int = 20) -> DataFrame:
    """peer, n, gap statistics within each vantage, busiest hour; only peers with enough events."""
    w = Window.partitionBy("peer", "vantage").orderBy("ts", "txid")
    rows = seen.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    hour = F.floor(F.pmod(F.col("ts"), F.lit(86400.0)) / 3600).cast("int")
    stats = rows.groupBy("peer").agg(F.count("*").alias("n"), F.avg("gap").alias("gap_mean"), F.median("gap").alias("gap_median")).where(F.col("n") >= least)
    hours = seen.groupBy("peer", hour.alias("hour")).agg(F.count("*").alias("k"))
    busiest = hours.groupBy("peer").agg(F.max_by("hour", F.struct("k", -F.col("hour"))).alias("busiest_hour"))
    return stats.join(busiest, "peer")


def ip_class(ip: Column, relay: Column, tor: Column, hosting: Column, high_risk: Column) -> Column:
    """By precedence: onion address, known relay, Tor exit, hosting network, high-risk network, else residential."""
    return (
        F.when(ip.endswith(".onion"), "tor").when(relay, "relay").when(tor, "tor").when(hosting, "hosting").when(high_risk, "high_risk").otherwise("residential")
    )
