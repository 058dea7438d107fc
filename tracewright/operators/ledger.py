"""Transactions: collapse of relay rows, spend links, address and transaction features, entity graph.

Frames: ``txs(txid, ts, fee)``, ``ins(txid, idx, addr, value)``, ``outs(txid, idx, addr, value)``; ts in epoch seconds.
Every group key here is a transaction, an address or an entity; all reductions are partial aggregations or windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT, LONG_WITNESS, SCRIPT_PREFIXES, Config


def collapse(rows: DataFrame, key: str = "txid", order: str = "_src_row", ip: str = "src_ip") -> DataFrame:
    """One row a transaction: the first row's columns, the number of rows, and IPs in order of first appearance."""
    rest = [c for c in rows.columns if c not in (key, order, ip)]
    first = F.min_by(F.struct(*rest), F.col(order)) if rest else None
    seen = F.array_sort(F.collect_set(F.struct(F.col("_at"), F.col(ip))))
    per_ip = rows.groupBy(key, ip).agg(F.min(order).alias("_at"))
    ips = per_ip.where(F.col(ip).isNotNull()).groupBy(key).agg(F.transform(seen, lambda x: x[ip]).alias("ips"))
    head = rows.groupBy(key).agg(*([first.alias("_f")] if rest else []), F.count("*").alias("n_rows"))
    return head.join(ips, key, "left").select(key, *[F.col(f"_f.{c}") for c in rest], "n_rows", "ips")


def script_type(addr: Column) -> Column:
    out = F.when(addr.startswith("bc1q") & (F.length(addr) > LONG_WITNESS), "p2wsh")
    for prefix, kind in SCRIPT_PREFIXES:
        out = out.when(addr.startswith(prefix), kind)
    return out.otherwise("")


def equal_group(values: Column, tolerance: float) -> Column:
    """struct(n, value) of the first value whose near-equals are most: |w - v| <= tolerance * max(v, tiny)."""
    at = F.sequence(F.lit(0), F.size(values) - 1)
    near = lambda v: F.size(F.filter(values, lambda w: F.abs(w - v) <= tolerance * F.greatest(v, F.lit(1e-12))))
    groups = F.transform(at, lambda i: F.struct(near(values[i]).alias("n"), (-i).alias("first"), values[i].alias("value")))
    best = F.array_max(groups)
    return F.when(F.size(values) > 0, F.struct(best["n"].alias("n"), best["value"].alias("value")))


def coinjoin(n_in: Column, values: Column, c: Config = DEFAULT) -> Column:
    g = equal_group(values, c.equal_tolerance)
    return F.coalesce(
        (n_in >= c.coinjoin_inputs) & (F.size(values) >= c.coinjoin_outputs) & (g["n"] >= c.coinjoin_group)
        & (g["value"] > c.dust) & (g["n"] <= n_in), F.lit(False),
    )


def round_amount(value: Column, c: Config = DEFAULT) -> Column:
    """A multiple of one of the units within the tolerance, and no smaller than it."""
    hit = F.lit(False)
    for u in c.round_units:
        hit = hit | ((value >= u) & (F.abs(value / u - F.rint(value / u)) * u <= c.round_tolerance))
    return hit


def edges(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """The wallet graph: kind, src, dst, idx, value. in: wallet to transaction; out: transaction to wallet."""
    a = ins.select(F.lit("in").alias("kind"), F.col("addr").alias("src"), F.col("txid").alias("dst"), "idx", "value")
    b = outs.select(F.lit("out").alias("kind"), F.col("txid").alias("src"), F.col("addr").alias("dst"), "idx", "value")
    return a.unionByName(b)


def first_spender(ins: DataFrame, txs: DataFrame) -> DataFrame:
    """addr -> txid, ts of the first transaction that spends from it, by time, then txid."""
    rows = ins.join(txs.select("txid", "ts"), "txid")
    return rows.groupBy("addr").agg(F.min(F.struct("ts", "txid")).alias("f")).select("addr", "f.txid", "f.ts")


def tx_features(txs: DataFrame, ins: DataFrame, outs: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Per transaction: sizes, amounts, equal outputs, peel ratio (two outputs only), CoinJoin.

    Sizes and ratios come from plain aggregates, so that who asks for them alone gathers no list of outputs.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
    o = outs.groupBy("txid").agg(values.alias("values"), F.count("*").alias("n_out"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("out_value"))
    i = ins.groupBy("txid").agg(F.countDistinct("addr").alias("n_in"), F.sum("value").alias("in_value"))
    g = equal_group(F.col("values"), c.equal_tolerance)
    return txs.join(i, "txid", "left").join(o, "txid", "left").select(
        "txid", "ts", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("int").alias("n_out"),
        "in_value", "out_value", g["n"].alias("equal_outputs"),
        F.when(F.col("n_out") == 2, F.col("least") / F.col("most")).alias("peel_ratio"),
        coinjoin(F.coalesce("n_in", F.lit(0)), F.col("values"), c).alias("coinjoin"),
    )


def in_mixes(outs: DataFrame, least: int, c: Config = DEFAULT, key: str = "txid") -> DataFrame:
    """outs with a column mix: whether least or more outputs of its transaction are about equal to one of them (as in equal_group).

    In order of their values, those near one lie side by side around it: enough of them are near if both ends of some run of
    least places that holds it are. So a row looks back over its run, and no list of a transaction's outputs is made.
    """
    w = Window.partitionBy(key).orderBy("value")
    run = [F.lag("value", k).over(w) if k else F.col("value") for k in range(least)]
    near = lambda at, v: F.abs(at - v) <= c.equal_tolerance * F.greatest(v, F.lit(1e-12))
    found = reduce(lambda a, b: a | b, [F.coalesce(near(run[0], v) & near(run[-1], v), F.lit(False)) for v in run])
    return outs.withColumn("mix", found).withColumn("mix", F.max("mix").over(Window.partitionBy(key)))


def named(rows: DataFrame, membership: DataFrame, addr: str = "addr", as_: str = "entity") -> DataFrame:
    """rows with the entity of an address, which is the address itself where it has none."""
    m = membership.select(F.col("node").alias("_a"), F.col("component").alias("_c"))
    return rows.join(m, F.col(addr) == F.col("_a"), "left").withColumn(as_, F.coalesce("_c", addr)).drop("_a", "_c")


def entity_rollup(ins: DataFrame, outs: DataFrame, txs: DataFrame, who: str = "addr") -> DataFrame:
    """Per entity: transactions in and out, values, distinct counterparties on either side, lifetime, velocity, fan-in."""
    i = ins.select("txid", F.col(who).alias("e"), "value")
    o = outs.select("txid", F.col(who).alias("e"), "value")
    sent = i.groupBy("e").agg(F.countDistinct("txid").alias("txs_out"), F.sum("value").alias("value_out"))
    got = o.groupBy("e").agg(F.countDistinct("txid").alias("txs_in"), F.sum("value").alias("value_in"))
    met = i.select("txid", F.col("e").alias("src")).distinct().join(o.select("txid", F.col("e").alias("dst")).distinct(), "txid")
    met = met.where("src <> dst").select("src", "dst").distinct()
    to = met.groupBy(F.col("src").alias("e")).agg(F.count("*").alias("counterparties_out"))
    of = met.groupBy(F.col("dst").alias("e")).agg(F.count("*").alias("counterparties_in"))
    life = i.select("txid", "e").unionByName(o.select("txid", "e")).distinct().join(txs.select("txid", "ts"), "txid")
    life = life.groupBy("e").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    rows = life
    for part in (sent, got, to, of):
        rows = rows.join(part, "e", "left")
    rows = rows.na.fill(0, ["txs_out", "txs_in", "counterparties_out", "counterparties_in"]).na.fill(0.0, ["value_out", "value_in"])
    days = F.greatest((F.col("last_seen") - F.col("first_seen")) / 86400.0, F.lit(1.0))
    both = F.col("counterparties_in") + F.col("counterparties_out")
    return rows.select(
        F.col("e").alias("entity"), "txs_in", "txs_out", "value_in", "value_out", "counterparties_in", "counterparties_out",
        ((F.col("txs_in") + F.col("txs_out")) / days).alias("velocity"),
        F.when(both > 0, F.col("counterparties_in") / both).otherwise(0.0).alias("fan_in"),
    )


def entity_edges(ins: DataFrame, outs: DataFrame, txs: DataFrame, mixes: DataFrame, who: str = "addr") -> DataFrame:
    """src, dst, value, n, mix_n, first_seen, last_seen: each output split over the senders by their share of the input."""
    i = ins.groupBy("txid", F.col(who).alias("src")).agg(F.sum("value").alias("sent"))
    share = F.col("sent") / F.sum("sent").over(Window.partitionBy("txid"))
    i = i.withColumn("share", share)
    o = outs.groupBy("txid", F.col(who).alias("dst")).agg(F.sum("value").alias("received"))
    m = mixes.select("txid").distinct().withColumn("mix", F.lit(1))
    rows = i.join(o, "txid").where("src <> dst").join(m, "txid", "left").join(txs.select("txid", "ts"), "txid")
    return rows.groupBy("src", "dst").agg(
        F.sum(F.col("received") * F.col("share")).alias("value"), F.count("*").alias("n"),
        F.sum(F.coalesce("mix", F.lit(0))).alias("mix_n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def change_votes(txs: DataFrame, ins: DataFrame, outs: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """txid, idx, addr of the one output that heuristics cannot tell from change, with its votes.

    Votes: the address is reused from the inputs; its script type is that of all inputs and not of all outputs; it is
    smaller than every input and not all outputs are.
    """
    i = ins.groupBy("txid").agg(
        F.collect_set("addr").alias("in_addrs"), F.min("value").alias("least_in"),
        F.collect_set(script_type(F.col("addr"))).alias("in_types"), F.countDistinct("addr").alias("n_in"),
    )
    every = Window.partitionBy("txid")
    rows = outs.join(i, "txid").withColumn("n_out", F.count("*").over(every))
    typed = (F.size("in_types") == 1) & (F.col("in_types")[0] != "") & (script_type(F.col("addr")) == F.col("in_types")[0])
    small = F.col("value") < F.col("least_in")
    rows = rows.withColumn("typed", typed).withColumn("small", small)
    not_all = lambda col: F.when(F.col(col) & ~F.min(F.col(col)).over(every), 1).otherwise(0)
    votes = F.when(F.array_contains("in_addrs", F.col("addr")), 1).otherwise(0) + not_all("typed") + not_all("small")
    rows = rows.withColumn("votes", votes)
    rows = rows.withColumn("most", F.max("votes").over(every))
    rows = rows.withColumn("winners", F.sum(F.when(F.col("votes") == F.col("most"), 1).otherwise(0)).over(every))
    return rows.where((F.col("votes") == F.col("most")) & (F.col("winners") == 1) & (F.col("votes") >= c.change_votes) & (F.col("n_out") >= 2)).select(
        "txid", "idx", "addr", "votes"
    )


def last_use_gap(ins: DataFrame, txs: DataFrame) -> DataFrame:
    """txid, gap: seconds since an input address was last used strictly before; the least over its inputs."""
    used = ins.select("txid", "addr").distinct().join(txs.select("txid", "ts"), "txid")
    moments = used.select("addr", "ts").distinct()
    moments = moments.withColumn("before", F.lag("ts").over(Window.partitionBy("addr").orderBy("ts")))
    return used.join(moments, ["addr", "ts"]).groupBy("txid").agg(F.min(F.col("ts") - F.col("before")).alias("gap"))


def dormancy(moments: DataFrame, key: str, c: Config = DEFAULT) -> DataFrame:
    """key, max_gap (days), burst: the most events within the burst window that opens after a long gap."""
    w = Window.partitionBy(key).orderBy("ts")
    ahead = w.rangeBetween(0, int(c.burst_days * 86400))
    rows = moments.withColumn("ts", F.col("ts").cast("long"))
    rows = rows.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).withColumn("burst", F.count("*").over(ahead))
    long_gap = F.col("gap") >= int(c.dormancy_days * 86400)
    return rows.groupBy(key).agg(
        F.coalesce(F.max("gap") / 86400.0, F.lit(0.0)).alias("max_gap"),
        F.coalesce(F.max(F.when(long_gap, F.col("burst"))), F.lit(0)).alias("burst"),
    )
