"""When an origin may be named: reasons by severity, their tiers, and what an answer may claim under a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons by severity, and the tier of each.
REASONS = (
    ("DEGENERATE", "ABSTAIN"), ("NOT_REACHABLE", "ABSTAIN"), ("COINJOIN", "QUALIFIED"), ("TOR_ONION", "QUALIFIED"), ("DANDELION_STEM", "ANNOTATE"), ("V2_PASSIVE_TAP", "ANNOTATE"),
)
#: Policies: the tiers at which each withholds an answer.
POLICIES = {"off": (), "tiered": ("ABSTAIN",), "binary": ("ABSTAIN", "QUALIFIED", "ANNOTATE")}
STEM_RATIO = 5.0
STEM_CANDIDATES = 4
TARGET_GROUP = 10
NOT_OWNERS = "not attributable: a CoinJoin's inputs have many owners"


def fired(facts: DataFrame) -> list[Column]:
    """A struct (reason, confidence) or null for each reason, in order of severity.

    facts: n_candidates, scope_out, peer, n (announcements), first_gap, later_gap, equal_outputs, coinjoin, source, unreadable_flows.
    """
    ratio = F.when(F.col("later_gap") > 0, F.col("first_gap") / F.col("later_gap")).otherwise(float("inf"))
    stem = (F.col("n") >= STEM_CANDIDATES) & (F.col("first_gap") > 0) & (ratio >= STEM_RATIO)
    one = F.lit(1.0)
    tests = {
        "DEGENERATE": (F.col("n_candidates") <= 1, one),
        "NOT_REACHABLE": (F.col("scope_out"), one),
        "COINJOIN": (F.col("coinjoin"), F.least(one, F.col("equal_outputs") / F.lit(float(TARGET_GROUP)))),
        "TOR_ONION": (F.col("peer").endswith(".onion"), one),
        "DANDELION_STEM": (stem, 1.0 - 0.5 * STEM_RATIO / ratio),
        "V2_PASSIVE_TAP": (F.col("source").startswith("pcap:") & (F.col("unreadable_flows") > 0), one),
    }
    return [F.when(F.coalesce(tests[name][0], F.lit(False)), F.struct(F.lit(name).alias("reason"), F.round(tests[name][1], 3).alias("confidence"))) for name, _ in REASONS]


def verdicts(facts: DataFrame, *keys: str) -> DataFrame:
    """keys, reason (the most severe, or VALID), confidence, reasons (all, in order), tier."""
    found = F.array_compact(F.array(*fired(facts)))
    tier = F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS for x in kv]), F.col("reason"))
    rows = facts.select(*keys, found.alias("found")).select(
        *keys, F.coalesce(F.get("found", F.lit(0))["reason"], F.lit("VALID")).alias("reason"), F.coalesce(F.get("found", F.lit(0))["confidence"], F.lit(1.0)).alias("confidence"),
        F.array_join(F.transform("found", lambda x: x["reason"]), ",").alias("reasons"),
    )
    return rows.withColumn("tier", F.coalesce(tier, F.lit("PASS")))


def withholds(tier: Column, policy: str) -> Column:
    return tier.isin(*POLICIES[policy]) if POLICIES[policy] else F.lit(False)


def answers(rows: DataFrame, policy: str = "tiered") -> DataFrame:
    """rows (peer, reasons, tier) with kind, ip, onion and input_ownership: what may be said of the peer, all null if nothing.

    Only the tiered policy qualifies: an onion identity has no ip, and who broadcast a CoinJoin owns none of its inputs.
    """
    has = lambda r: F.array_contains(F.split("reasons", ","), r) if policy == "tiered" else F.lit(False)
    told = F.col("peer").isNotNull() & ~withholds(F.col("tier"), policy)
    kind = F.when(~told, None).when(has("TOR_ONION"), "onion_identity").when(has("COINJOIN"), "broadcasting_peer").otherwise("ip_attribution")
    out = rows.withColumn("kind", kind)
    onion = F.col("kind") == "onion_identity"
    return out.withColumns({"ip": F.when(~onion, F.col("peer")), "onion": F.when(onion, F.col("peer")), "input_ownership": F.when(has("COINJOIN") & told, NOT_OWNERS)})


def of_matrix(matrix: DataFrame, named: DataFrame | None, shapes: DataFrame) -> DataFrame:
    """One verdict per capture and transaction of a relay matrix, about the peer that named (capture, txid, peer) says; without
    named, about the first to announce.

    shapes: txid, equal_outputs, coinjoin.
    """
    tx = Window.partitionBy("capture", "txid").orderBy("announce_ts", "peer_ip")
    rows = matrix.withColumns({"gap": F.col("announce_ts") - F.lag("announce_ts").over(tx), "at": F.row_number().over(tx)})
    facts = rows.groupBy("capture", "txid").agg(
        F.max("candidate_count").alias("n_candidates"), F.max("scope_out").alias("scope_out"), F.count("*").alias("n"), F.max(F.when(F.col("at") == 2, F.col("gap"))).alias("first_gap"),
        F.median(F.when(F.col("at") > 2, F.col("gap"))).alias("later_gap"), F.min("source").alias("source"), F.max("unreadable_flows").alias("unreadable_flows"),
        F.max(F.when(F.col("at") == 1, F.col("peer_ip"))).alias("peer"),
    )
    if named is not None:
        facts = facts.drop("peer").join(named.select("capture", "txid", "peer"), ["capture", "txid"], "left")
    facts = facts.join(shapes.select("txid", "equal_outputs", "coinjoin"), "txid", "left")
    return verdicts(facts, "capture", "txid", "peer")


def of_links(observations: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """entity, ip, n, n_flagged, reasons: how many of a lead's transactions have a verdict, and which, by count, then name."""
    rows = observations.select("entity", "ip", "txid").distinct().join(verdicts_.select("txid", "reasons"), "txid", "left")
    each = rows.select("entity", "ip", "txid", F.explode_outer(F.filter(F.split(F.coalesce("reasons", F.lit("")), ","), lambda r: r != "")).alias("r"))
    held = each.groupBy("entity", "ip", "r").agg(F.count("*").alias("k")).where("r is not null")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "r"))), lambda x: F.concat(x["r"], F.lit("x"), (-x["k"]).cast("string"))), ",")
    total = each.groupBy("entity", "ip").agg(F.countDistinct("txid").alias("n"), F.countDistinct(F.when(F.col("r").isNotNull(), F.col("txid"))).alias("n_flagged"))
    return total.join(held.groupBy("entity", "ip").agg(listed.alias("reasons")), ["entity", "ip"], "left").na.fill("", ["reasons"])


def policy_table(decided: DataFrame) -> DataFrame:
    """policy, answered, right: decided (tier, right 0/1) under each policy."""
    told = {name: ~withholds(F.col("tier"), name) for name in POLICIES}
    sums = lambda t: (F.coalesce(F.sum(t.cast("long")), F.lit(0)), F.coalesce(F.sum((t & (F.col("right") == 1)).cast("long")), F.lit(0)))
    row = decided.agg(F.array(*[F.struct(F.lit(name).alias("policy"), a.alias("answered"), b.alias("right")) for name, t in told.items() for a, b in [sums(t)]]).alias("p"))
    return row.select(F.inline("p"))
