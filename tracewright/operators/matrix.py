"""The relay matrix: one row per transaction and candidate peer of a capture, and what is set aside.

Frames: ``events`` as the capture readers give them, with a column capture; ``classes(ip, ip_class)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import relay
from tracewright.session import written

ANNOUNCED = ("inv", "tx")
#: Part of a user agent in lower case -> family, first match wins.
AGENTS = (("satoshi", "core"), ("bitcoin core", "core"), ("btcd", "btcd"), ("bcoin", "bcoin"), ("libbitcoin", "libbitcoin"), ("bitcoinj", "bitcoinj"), ("knots", "knots"), ("gocoin", "gocoin"))
STANDARD_PORT = 8333
#: Classes that say nothing of a sender.
RELAYS = ("relay",)


class VantageError(ValueError):
    """Delays can be compared within one vantage point only."""


def observer_of(explicit=None, labels: dict | None = None, settings: dict | None = None) -> tuple[set[str], str]:
    """The observer's own addresses and how they are known: an argument, a label file, the settings; never a guess."""
    for found, basis in ((explicit, "explicit"), ((labels or {}).get("observer_local_ips"), "label_file"), ((settings or {}).get("local_ips"), "config:p2p.local_ips")):
        if found:
            return {str(x) for x in found}, basis
    raise VantageError("the observer's own address is unknown: inbound and outbound cannot be told apart")


def agent_family(agent: Column) -> Column:
    low = F.lower(agent)
    out = F.when(F.coalesce(agent, F.lit("")) == "", "unknown")
    for part, name in AGENTS:
        out = out.when(low.contains(part), name)
    return out.otherwise("other")


def is_v6(ip: Column) -> Column:
    return ip.contains(":")


def is_onion(ip: Column) -> Column:
    return ip.endswith(".onion")


def provenance(source: Column) -> Column:
    """fixture, simulated or capture, by how a source's name begins."""
    return F.when(source.startswith("fixture:"), "fixture").when(source.startswith("sim:") | source.isNull(), "simulated").otherwise("capture")


def announcements(events: DataFrame, observers: set[str]) -> DataFrame:
    """What counts: inbound announcements of other peers, at a known time."""
    own = F.col("peer_ip").isin(*observers) if observers else F.lit(False)
    return events.where(F.col("message_type").isin(*ANNOUNCED) & (F.col("direction") == "inbound") & F.col("peer_ip").isNotNull() & F.col("ts").isNotNull() & ~own)


def relay_frame(events: DataFrame, observer: str) -> DataFrame:
    """txid, src, dst, ts: each announcement as a hop to the observer."""
    return events.select("txid", F.col("peer_ip").alias("src"), F.lit(observer).alias("dst"), "ts")


def quarantined(events: DataFrame) -> DataFrame:
    """Announcements still under a witness id: another identifier of a transaction, never merged with the rest."""
    reason = F.lit("unresolved wtxid: no tx message and no label file to resolve it")
    return events.where("message_type = 'inv_wtx'").select(F.concat_ws(":", "capture", "source").alias("source_file"), "txid", reason.alias("reason"), F.to_json(F.struct(*events.columns)).alias("raw"))


def candidate_scores(rows: DataFrame) -> DataFrame:
    """rows (capture, txid, peer_ip, ts: a candidate's first announcement) with est_first_timestamp and its place.

    These are relay.first_timestamp's scores with the observer struck out and places closed up. As every hop ends at the
    observer, it is first seen with the earliest candidates and comes behind them, so the scores are read off the places.
    """
    tx = Window.partitionBy("capture", "txid")
    place, n = F.row_number().over(tx.orderBy("ts", "peer_ip")), F.count("*").over(tx) + 1
    ahead = place - 1 + (F.col("ts") > F.min("ts").over(tx)).cast("int")
    return rows.withColumns({"est_first_timestamp": (n - ahead) / n, "est_first_timestamp_place": place})


def _known(events: DataFrame, classes: DataFrame) -> DataFrame:
    """capture, peer_ip, user_agent (the latest), services, ip_class of every peer of a capture."""
    told = F.max(F.when(F.col("user_agent").isNotNull(), F.col("ts"))).alias("told")
    per = events.where("peer_ip is not null").groupBy("capture", "peer_ip", "user_agent").agg(told, F.max("services").alias("services"))
    per = per.groupBy("capture", "peer_ip").agg(F.max_by("user_agent", "told").alias("user_agent"), F.max("services").alias("services"))
    return per.join(classes.select(F.col("ip").alias("peer_ip"), "ip_class"), "peer_ip", "left")


def candidates(events: DataFrame, classes: DataFrame, observers: set[str], basis: str = "explicit", sure: dict[str, float] | None = None) -> DataFrame:
    """The matrix without history and scores, with ts beside announce_ts."""
    return _compared(_first(events, classes, observers), observers, basis, sure)


def _first(events: DataFrame, classes: DataFrame, observers: set[str]) -> DataFrame:
    """One row a candidate: its first announcement of the transaction, and what is known of it."""
    used = announcements(events, observers).select("capture", "txid", "peer_ip", "ts", "message_type", "peer_port", "transport", "unreadable_flows", "source")
    at = F.row_number().over(Window.partitionBy("capture", "txid", "peer_ip").orderBy("ts", "message_type", "source"))
    rows = used.withColumn("announced", F.count("*").over(Window.partitionBy("capture", "txid"))).withColumn("k", at).where("k = 1").drop("k", "message_type")
    return rows.join(_known(events, classes), ["capture", "peer_ip"], "left").withColumn("ip_class", F.coalesce("ip_class", F.lit("residential")))


def _compared(rows: DataFrame, observers: set[str], basis: str, sure: dict[str, float] | None, *rest: str) -> DataFrame:
    observer = min(observers)
    tx = Window.partitionBy("capture", "txid")
    sd = F.coalesce(F.stddev_samp("ts").over(tx), F.lit(0.0))
    rank = F.rank().over(tx.orderBy("ts"))
    return rows.select(
        "capture", "txid", "peer_ip", F.lit(observer).alias("observer_ip"), F.lit(",".join(sorted(observers))).alias("observer_ips"), F.lit("inbound").alias("direction"),
        F.lit(basis).alias("direction_basis"), F.lit((sure or {}).get(basis, 1.0)).alias("direction_confidence"), "source", F.col("ts").alias("announce_ts"), rank.alias("announce_rank"),
        (rank == 1).alias("is_first"), F.count("*").over(tx).alias("candidate_count"), (F.col("ts") - F.min("ts").over(tx)).alias("delta_first"), (F.col("ts") - F.median("ts").over(tx)).alias("delta_median"),
        F.when(sd > 0, (F.col("ts") - F.avg("ts").over(tx)) / sd).otherwise(0.0).alias("delta_z"), (F.max("ts").over(tx) - F.min("ts").over(tx)).alias("span"), "announced", "peer_port",
        (F.col("peer_port").isNotNull() & (F.col("peer_port") != STANDARD_PORT)).alias("non_standard_port"), is_v6(F.col("peer_ip")).alias("is_v6"), is_onion(F.col("peer_ip")).alias("is_onion"),
        F.coalesce(F.col("transport") == "v2", F.lit(False)).alias("transport_v2"), "unreadable_flows", "user_agent", agent_family(F.col("user_agent")).alias("agent_family"), "services", "ip_class",
        (F.count("*").over(tx) <= 1).alias("degenerate"), F.min(F.col("ip_class").isin(*RELAYS)).over(tx).alias("scope_out"), "ts", *rest,
    )


def matrix(events: DataFrame, classes: DataFrame, observers: set[str], basis: str = "explicit", sure: dict[str, float] | None = None, medians: bool = True) -> DataFrame:
    """The matrix. A peer that announced a transaction twice is one candidate, timed from its first announcement.

    Windows run over the candidates of a transaction of a capture; a peer's agent, services and history are those of its
    capture. Rows go to their peer once, for all that is known of it, and to their transaction. Running medians of gaps take
    several passes (relay.running_medians); without medians there is no gap_median.
    """
    past = ["txids_before", "firsts_before", "gap_mean", "gap_sd", "rate", "age", "first_share"]
    rows = relay.earlier(_first(events, classes, observers), ("capture", "txid"), ("capture", "peer_ip"))
    if medians:
        rows = written(rows.withColumn("peer", F.concat_ws("\x1f", "capture", "peer_ip")), "matrix-history")
        rows = rows.join(relay.running_medians(rows.select("peer", "at", "value"), "peer"), ["peer", "at"], "left").withColumnRenamed("median", "gap_median")
        past.insert(3, "gap_median")
    return candidate_scores(_compared(rows, observers, basis, sure, *past)).drop("ts")


def pooled(parts: list[DataFrame], across: bool = False) -> DataFrame:
    """Matrices of several captures as one; VantageError if their observers differ and pooling across was not asked for."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not across and out.select("observer_ips").distinct().limit(2).count() > 1:
        raise VantageError("captures of different observers: delays are comparable within one vantage point only")
    return out


def abstains(rows: DataFrame) -> DataFrame:
    """Rows no answer can come from: one candidate, or public relays alone."""
    return rows.where(F.col("degenerate") | F.col("scope_out"))


def summary(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: rows, transactions, peers, shares of degenerate and out-of-scope rows, quarantined announcements."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_share")
    n = rows.agg(F.count("*").alias("rows"), F.countDistinct("capture", "txid").alias("txids"), F.countDistinct("peer_ip").alias("peers"), share("degenerate"), share("scope_out"))
    return n.join(quarantine.agg(F.count("*").alias("quarantined")))  # one row each
