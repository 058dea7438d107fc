"""Evaluation reports as aggregations: ceilings, cases, leads, saturation, exit points, false alarms, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.metrics import before, quantiles


def ceiling(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """all, multi, n_all, n_multi: how often the true origin (txid, ip) is among a tree's nodes at all, over all trees and those of several nodes."""
    per = nodes.groupBy("txid").agg(F.count("*").alias("n"))
    hit = truth.join(nodes.select("txid", "ip", F.lit(1.0).alias("hit")).distinct(), ["txid", "ip"], "left").join(per, "txid")
    many = F.col("n") > 1
    got = F.coalesce("hit", F.lit(0.0))
    return hit.agg(F.avg(got).alias("all"), F.avg(F.when(many, got)).alias("multi"), F.count("*").alias("n_all"), F.sum(many.cast("long")).alias("n_multi"))


def cases(actors: DataFrame, alerted: DataFrame, reached: DataFrame) -> DataFrame:
    """typology, cases, detected, coverage: a case (actor, typology, entity) is detected if an entity of it has an alert (entity);
    coverage is the mean share of its entities that were reached (entity)."""
    rows = actors.join(alerted.select("entity").distinct().withColumn("a", F.lit(1)), "entity", "left").join(reached.select("entity").distinct().withColumn("r", F.lit(1.0)), "entity", "left")
    per = rows.groupBy("typology", "actor").agg(F.max(F.coalesce("a", F.lit(0))).alias("hit"), F.avg(F.coalesce("r", F.lit(0.0))).alias("share"))
    return per.groupBy("typology").agg(F.count("*").alias("cases"), F.sum("hit").alias("detected"), F.avg("share").alias("coverage"))


def broadcast_truth(origins: DataFrame, members: DataFrame) -> DataFrame:
    """entity, ips: the true broadcasting addresses (txid, entity, ip) of each entity, sorted."""
    m = members.select(F.col("node").alias("entity"), "component")
    rows = origins.join(m, "entity", "left").withColumn("entity", F.coalesce("component", "entity"))
    return rows.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("ip")), ",").alias("ips"))


def lead_precision(leads: DataFrame, truth: DataFrame, edges: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """by, part, n, right, precision of leads (entity, ip, score, txs) against truth (entity, ip): by score band, by observations, by place in the entity's list."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("score").desc(), "ip"))
    rows = leads.withColumn("place", place).join(truth.select("entity", "ip").distinct().withColumn("ok", F.lit(1)), ["entity", "ip"], "left").withColumn("ok", F.coalesce("ok", F.lit(0)))
    band = F.lit(f">={edges[-1]}")
    for e in reversed(edges):
        band = F.when(F.col("score") < e, f"<{e}").otherwise(band)
    seen = F.when(F.col("txs") == 1, "1").when(F.col("txs") <= 4, "2-4").otherwise("5+")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("by"), c.cast("string").alias("part")) for k, c in (("score", band), ("observations", seen), ("place", F.col("place")))])).alias("x")
    return rows.select("ok", kinds).groupBy("x.by", "x.part").agg(F.count("*").alias("n"), F.sum("ok").alias("right"), F.avg("ok").alias("precision"))


def saturation(queue: DataFrame, score: str, key: list[str], places: int = 4) -> DataFrame:
    """n, scores, shown, keys, largest, at_top: how far a score tells alerts apart, exactly, as shown, and by the whole sort key."""
    shown = F.round(score, places)
    by_key = queue.groupBy(*key).agg(F.count("*").alias("k"))
    top = queue.agg(F.max(score).alias("top"))
    rows = queue.join(top)  # one row
    out = rows.agg(F.count("*").alias("n"), F.countDistinct(score).alias("scores"), F.countDistinct(shown).alias("shown"), F.sum((F.col(score) == F.col("top")).cast("long")).alias("at_top"))
    return out.join(by_key.agg(F.count("*").alias("keys"), F.max("k").alias("largest")))  # one row each


#: Fixed value: the linear score from which on three places show no difference.
FLAT = 7.6


def alerts_of(rows: DataFrame, weights: dict[str, float], bias: float, threshold: float) -> DataFrame:
    """The signals of the rows whose score reaches the threshold, with logit and score; a signal that is null weighs 0."""
    z = F.lit(bias)
    for s, w in weights.items():
        z = z + F.coalesce(F.col(s).cast("double"), F.lit(0.0)) * w
    out = rows.select(*[F.col(s).cast("double").alias(s) for s in weights], z.alias("logit"))
    return out.withColumn("score", 1 / (1 + F.exp(-F.col("logit")))).where(F.col("score") >= threshold)


def diagnosis(alerts: DataFrame, signals: list[str], places: int = 3, flat: float = FLAT) -> DataFrame:
    """One row: where a score (``alerts_of``) loses its resolution.

    alerts; shown and vectors, the distinct scores as shown and the distinct inputs; largest and sharing, the largest group of
    equal inputs and the alerts in such groups; logit_min, logit_max, logits; above_flat; collapsed, the distinct inputs beyond
    the first behind one shown score. Each alert then has one cause: own_score (no other alert shows its score), equal_inputs
    (another has its inputs too), capped (its score is flat), rounded (else). Null inputs are equal to each other alone.

    Alerts are counted by inputs and shown score first. What is joined back is one row a shown score, 10^places + 1 at most.
    """
    inputs = F.struct(*[F.round(s, 6).alias(s) for s in signals])
    rows = alerts.select(inputs.alias("inputs"), F.round("score", places).alias("shown"), "logit")
    n, logit = F.count("*").alias("n"), F.col("logit")
    cells = rows.groupBy("inputs", "shown").agg(n, F.min(logit).alias("lo"), F.max(logit).alias("hi"), F.sum((logit >= flat).cast("long")).alias("above"))
    by_shown = cells.groupBy("shown").agg(F.count("*").alias("vectors"), F.sum("n").alias("all"))
    by_inputs = cells.groupBy("inputs").agg(F.sum("n").alias("n"))
    shares = by_inputs.agg(F.count("*").alias("vectors"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("sharing"))
    scores = by_shown.agg(F.count("*").alias("shown"), F.coalesce(F.sum(F.col("vectors") - 1), F.lit(0)).alias("collapsed"))
    cause = F.when(F.col("all") == 1, "own_score").when(F.col("n") > 1, "equal_inputs").when(F.col("lo") >= flat, "capped").otherwise("rounded")
    told = cells.join(F.broadcast(by_shown.select("shown", "all")), "shown").withColumn("cause", cause)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    causes = [total(F.when(F.col("cause") == c, F.col("n"))).alias(c) for c in ("own_score", "equal_inputs", "capped", "rounded")]
    sums = told.agg(total("n").alias("alerts"), F.min("lo").alias("logit_min"), F.max("hi").alias("logit_max"), total("above").alias("above_flat"), *causes)
    logits = rows.agg(F.countDistinct(F.round(logit, 6)).alias("logits"))
    return sums.join(shares).join(scores).join(logits)  # one row each


def input_spread(alerts: DataFrame, signals: list[str]) -> DataFrame:
    """signal, min, median, max, distinct (to six places), at_max, zero of each signal among alerts: is it full before it is summed?

    Nulls count nowhere. Values are counted first; medians are looked up among the running counts of all signals at once.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals])).alias("p")
    held = alerts.select(pairs).select("p.*").where("v is not null").groupBy("signal", "v").agg(F.count("*").alias("n"))
    held = before(held, [F.col("signal").asc(), F.col("v").asc()], start=F.col("n"))
    ends = held.groupBy("signal").agg(F.min("start").alias("first"), F.sum("n").alias("total"), F.max("v").alias("top"))
    x = held.join(F.broadcast(ends), "signal").withColumn("at", F.col("start") - F.col("first"))  # one row a signal
    rank = lambda r: F.max(F.when((F.col("at") <= r) & (F.col("at") + F.col("n") > r), F.col("v")))
    last = F.col("total") - 1
    out = x.groupBy("signal").agg(
        F.min("v").alias("min"), ((rank(F.floor(last / 2)) + rank(F.ceil(last / 2))) / 2).alias("median"), F.max("v").alias("max"), F.countDistinct(F.round("v", 6)).alias("distinct"),
        F.sum(F.when(F.col("v") >= F.col("top") - 1e-9, F.col("n")).otherwise(0)).alias("at_max"), F.sum(F.when(F.col("v") <= 1e-12, F.col("n")).otherwise(0)).alias("zero"),
    )
    return out


def nearest_deciles(rows: DataFrame, value: str) -> DataFrame:
    """decile, value: values that some row has, at the ranks nearest to the tenths (a half to the even rank); no row, no deciles."""
    held = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    held = before(held, [F.col("v").asc()], start=F.col("n")).join(held.agg((F.sum("n") - 1).alias("last")))  # one row
    ranks = F.array(*[F.struct(F.lit(k).alias("decile"), F.bround(F.col("last") * k / 10.0).cast("long").alias("r")) for k in range(11)])
    mine = F.filter(ranks, lambda x: (x["r"] >= F.col("start")) & (x["r"] < F.col("start") + F.col("n")))
    return held.select(F.explode(mine).alias("x"), F.col("v").alias("value")).select("x.decile", "value")


def deciles(rows: DataFrame, value: str) -> DataFrame:
    """decile, value: exact deciles of a column."""
    got = quantiles(rows, value, [k / 10 for k in range(11)])
    return rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(got)], "decile int, value double")  # eleven rows


def false_alarms(scores: DataFrame, threshold: float, parts: list[str]) -> DataFrame:
    """band, n, over, and how often each signal led: scores (risk and parts) of a world without crime, by tenths of risk."""
    band = F.least(F.floor(F.col("risk") * 10), F.lit(9)).cast("int")
    best = F.greatest(*[F.col(p) for p in parts])
    lead = F.coalesce(*[F.when((F.col(p) == best) & (best > 0), p) for p in parts])
    over = F.col("risk") >= threshold
    return scores.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum(over.cast("long")).alias("over"), *[F.sum((over & (lead == p)).cast("long")).alias(f"led_{p}") for p in parts])


def runs(rows: DataFrame, group: str) -> DataFrame:
    """A batch of trials (group, detected, seconds, to_detect): n, detected, rate, median seconds, median transactions to detect."""
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(F.col("detected").cast("long")).alias("detected"), F.avg(F.col("detected").cast("double")).alias("rate"), F.median("seconds").alias("seconds"), F.median("to_detect").alias("to_detect"),
    )


def first_hit(rows: DataFrame, key: str, order: list[Column], hit: Column) -> DataFrame:
    """key, n: how many rows of an order it takes up to and with the first hit; keys without one are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("at", F.row_number().over(w)).where(hit).groupBy(key).agg(F.min("at").alias("n"))


def class_rates(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, n, told, right, precision, recall of each class."""
    t = rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(guess)).cast("long")).alias("right"))
    g = rows.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("told"))
    both = t.join(g, "label", "full").na.fill(0, ["n", "right", "told"])
    rate = lambda n: F.when(F.col(n) > 0, F.col("right") / F.col(n))
    return both.select("label", "n", "told", "right", rate("told").alias("precision"), rate("n").alias("recall"))


def crossed(parts: dict[tuple[str, ...], DataFrame], names: tuple[str, ...]) -> DataFrame:
    """One table of several runs, each with its setting in columns names."""
    rows = None
    for setting, part in parts.items():
        part = part.select(*[F.lit(v).alias(n) for n, v in zip(names, setting, strict=True)], "*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def compared(before: DataFrame, after: DataFrame, key: str, flag: str) -> DataFrame:
    """n, before, after, gained, lost: a flag per key in two runs over the same keys, as with and without a source."""
    rows = before.select(key, F.col(flag).alias("x")).join(after.select(key, F.col(flag).alias("y")), key)
    n = lambda c: F.sum(c.cast("long"))
    return rows.agg(F.count("*").alias("n"), n(F.col("x")).alias("before"), n(F.col("y")).alias("after"), n(~F.col("x") & F.col("y")).alias("gained"), n(F.col("x") & ~F.col("y")).alias("lost"))


def exit_scores(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """seeds, top1, top3, mean_share: ranked exit points (seed, node, share, rank) against the true ones (seed, node)."""
    hit = ranked.join(truth.select("seed", "node").distinct().withColumn("ok", F.lit(1)), ["seed", "node"], "left")
    per = hit.groupBy("seed").agg(F.max(F.when((F.col("rank") == 1) & (F.col("ok") == 1), 1).otherwise(0)).alias("a"), F.max(F.when((F.col("rank") <= 3) & (F.col("ok") == 1), 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("ok") == 1, F.col("share")).otherwise(0.0)).alias("s"))
    every = truth.select("seed").distinct().join(per, "seed", "left").na.fill(0)
    return every.agg(F.count("*").alias("seeds"), F.avg("a").alias("top1"), F.avg("b").alias("top3"), F.avg("s").alias("mean_share"))


def pattern_counts(alerts: DataFrame) -> DataFrame:
    """pattern, n, mean_risk of alerts (entity, risk, patterns array); an alert without patterns counts as none."""
    rows = alerts.select("risk", F.explode_outer("patterns").alias("pattern"))
    return rows.groupBy(F.coalesce("pattern", F.lit("none")).alias("pattern")).agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"))


def pooled_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """entity, mean, most: edge scores (txid, src, dst, score) as a mean per transaction, then over an entity's transactions on either end."""
    per = edges.select("txid", F.explode(F.array("src", "dst")).alias("node"), "score").groupBy("txid", "node").agg(F.avg("score").alias("score"))
    rows = per.join(members.select("node", "component"), "node", "left").withColumn("entity", F.coalesce("component", "node"))
    return rows.groupBy("entity").agg(F.avg("score").alias("mean"), F.max("score").alias("most"))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns less their mean over their sample deviation, or over 1 where that is 0."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit((stats[f"s_{c}"] or 0.0) or 1.0) for c in columns})


def provider_rollup(peers: DataFrame) -> DataFrame:
    """asn, peers, announcements, firsts, agents, first_seen, last_seen of peer profiles (peer, asn, n, firsts, agent, first_seen, last_seen)."""
    return peers.where("asn is not null").groupBy("asn").agg(
        F.count("*").alias("peers"), F.sum("n").alias("announcements"), F.sum("firsts").alias("firsts"), F.countDistinct("agent").alias("agents"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def first_known(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """key and, for each column, its first value that is not null."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
