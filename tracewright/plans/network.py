"""Announcements, origins, validity, correlation and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import relay, scoring
from tracewright.plans.adapters import Views, with_
from tracewright.plans.registry import query


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


@query(
    "q_announcement_stats",
    with_("ev", body=""" SELECT txid, peer, ts, rank() OVER (PARTITION BY txid ORDER BY ts) AS rank, rank() OVER (PARTITION BY txid ORDER BY ts) = 1 AS is_first, round(ts - min(ts) OVER w, 3) AS delta_first,
       round(ts - median(ts) OVER w, 3) AS delta_median, round(max(ts) OVER w - min(ts) OVER w, 3) AS span FROM ev WINDOW w AS (PARTITION BY txid)"""),
)
def _(v: Views) -> DataFrame:
    """Rank, deltas and span of each announcement."""
    rows = relay.announcement_stats(v.seen)
    return rows.select("txid", "peer", "ts", "rank", "is_first", _r("delta_first", 3), _r("delta_median", 3), _r("span", 3))


@query(
    "q_peer_history",
    with_("ev", body=""" , f AS (SELECT txid, peer, min(ts) AS ts FROM ev GROUP BY 1, 2), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY txid ORDER BY ts, peer) = 1 AS INT) AS opened, ts - lag(ts) OVER (PARTITION BY peer ORDER BY ts, txid) AS gap FROM f)
       , h AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(sum(opened) OVER b, 0) AS fb, avg(gap) OVER b AS gm, median(gap) OVER b AS gd, stddev_samp(gap) OVER b AS gs, ts - first_value(ts) OVER w AS el FROM o WINDOW w AS (PARTITION BY peer ORDER BY ts, txid), b AS (PARTITION BY peer ORDER BY ts, txid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT txid, peer, n AS txids_before, CAST(fb AS BIGINT) AS firsts_before, round(gm, 2) AS gap_mean, round(gd, 3) AS gap_median, round(CASE WHEN n = 2 THEN 0.0 ELSE gs END, 2) AS gap_sd, round(CASE WHEN el > 0 THEN n / (el / 60.0) END, 6) AS rate, round(CASE WHEN n > 0 THEN el END, 3) AS age, round(CASE WHEN n > 0 THEN fb / n END, 6) AS first_share FROM h"""),
)
def _(v: Views) -> DataFrame:
    """Strictly earlier history of a peer, all of it."""
    rows = relay.peer_history(v.seen)
    return rows.select("txid", "peer", F.col("txids_before").cast("long").alias("txids_before"), "firsts_before", _r("gap_mean", 2), _r("gap_median", 3), _r("gap_sd", 2), _r("rate"), _r("age", 3), _r("first_share"))


@query(
    "q_relatives",
    with_("ev", body=""" , s AS (SELECT txid, peer, min(ts) AS delta, count(*) AS score FROM ev GROUP BY 1, 2)
       SELECT txid, peer, round(lead(delta) OVER (PARTITION BY txid ORDER BY delta, peer) - delta, 3) AS lead, CAST(score - max(score) OVER w AS BIGINT) AS gap_to_best, round(score / greatest(1.0, sum(score) OVER w), 6) AS share, row_number() OVER (PARTITION BY txid ORDER BY score DESC, peer) AS place FROM s WINDOW w AS (PARTITION BY txid)"""),
)
def _(v: Views) -> DataFrame:
    """Lead, gap to the best, normalised share, rank."""
    s = v.seen.groupBy("txid", "peer").agg(F.min("ts").alias("delta"), F.count("*").alias("score"))
    return relay.relatives(s).select("txid", "peer", _r("lead", 3), "gap_to_best", _r("share"), "place")


@query(
    "q_tree_nodes",
    with_("ev", "hops", body=""" , e AS (SELECT txid, src AS ip, ts, ts AS sent FROM hops UNION ALL SELECT txid, dst, ts, NULL FROM hops) SELECT txid, ip, min(ts) AS first_seen, min(sent) AS first_sent FROM e GROUP BY 1, 2"""),
)
def _(v: Views) -> DataFrame:
    """Propagation tree nodes."""
    return relay.tree_nodes(v.hops)


_NODES = """ , e AS (SELECT txid, src AS ip, ts, ts AS sent FROM hops UNION ALL SELECT txid, dst, ts, NULL FROM hops), nd AS (SELECT txid, ip, min(ts) AS a, min(sent) AS b FROM e GROUP BY 1, 2),
  sc AS (SELECT txid, ip, (count(*) OVER w - (row_number() OVER (PARTITION BY txid ORDER BY a, CASE WHEN b = a THEN 0 ELSE 1 END, ip) - 1)) / count(*) OVER w AS score FROM nd WINDOW w AS (PARTITION BY txid))"""


@query("q_first_timestamp", with_("ev", "hops", body=_NODES + " SELECT txid, ip, round(score, 6) AS score FROM sc"))
def _(v: Views) -> DataFrame:
    """First-timestamp estimator (L1, L2)."""
    return relay.first_timestamp(relay.tree_nodes(v.hops)).select("txid", "ip", _r("score"))


@query(
    "q_origins",
    with_("ev", "hops", body=_NODES + """ , ob AS (SELECT txid, count(*) AS n FROM hops GROUP BY 1), cl AS (SELECT DISTINCT peer AS ip, CASE CAST(substr(peer, 2) AS BIGINT) % 7 WHEN 0 THEN 'tor' WHEN 1 THEN 'relay' WHEN 2 THEN 'hosting' ELSE 'residential' END AS k FROM ev),
       w AS (SELECT txid, ip, k, score * CASE k WHEN 'tor' THEN 0.2 WHEN 'relay' THEN 0.3 WHEN 'hosting' THEN 0.5 ELSE 1.0 END AS w FROM sc JOIN cl USING (ip)), r AS (SELECT *, sum(w) OVER (PARTITION BY txid) AS total, count(*) OVER (PARTITION BY txid) AS nn, row_number() OVER (PARTITION BY txid ORDER BY w DESC, ip) AS rk FROM w),
       c AS (SELECT txid, ip, k, CASE WHEN n <= 1 OR nn <= 1 THEN 0.15 ELSE least(1.0, greatest(0.0, w / total * (1 - exp(-n / 3.0)))) END AS conf FROM r JOIN ob USING (txid) WHERE rk = 1)
       SELECT txid, ip, k AS ip_class, round(conf, 6) AS confidence, k = 'relay' OR conf < 0.35 AS low_confidence, round(conf * CASE WHEN k IN ('tor', 'hosting') THEN 0.4 ELSE 1.0 END, 6) AS attribution FROM c"""),
)
def _(v: Views) -> DataFrame:
    """Origins: class weights, confidence, flags, discount."""
    k = F.substring("peer", 2, 9).cast("long") % 7
    classes = v.events.select(F.col("peer").alias("ip"), F.when(k == 0, "tor").when(k == 1, "relay").when(k == 2, "hosting").otherwise("residential").alias("ip_class")).distinct()
    n = v.hops.groupBy("txid").agg(F.count("*").alias("n"))
    rows = relay.origins(relay.first_timestamp(relay.tree_nodes(v.hops)), n, classes)
    return rows.select("txid", "ip", "ip_class", _r("confidence"), "low_confidence", _r("attribution"))


@query("q_rumor_centrality")
def _(v: Views) -> DataFrame:
    """Rumor centrality over each transaction's spanning tree."""
    return relay.rumor_centrality(v.hops).select("txid", "ip", _r("score"))


@query("q_blended_origin")
def _(v: Views) -> DataFrame:
    """The timestamp-weighted estimator (L4)."""
    return relay.blended(relay.first_timestamp(relay.tree_nodes(v.hops)), relay.rumor_centrality(v.hops)).select("txid", "ip", _r("score"))


@query(
    "q_isolation",
    with_("ev", body=""" , g AS (SELECT txid, ts - lag(ts) OVER w AS gap, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY txid ORDER BY ts, peer))
       SELECT txid, round(max(gap) FILTER (WHERE rn = 2), 3) AS first_gap, round(median(gap) FILTER (WHERE rn > 2), 3) AS later_gap FROM g GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """First gap against the later ones."""
    return relay.isolation(v.seen).select("txid", _r("first_gap", 3), _r("later_gap", 3))


@query(
    "q_noise_floor",
    with_("ev", "hops", body=""" , f AS (SELECT txid, src, min(ts) AS ts FROM hops GROUP BY 1, 2), g AS (SELECT ts - lag(ts) OVER (PARTITION BY txid ORDER BY ts, src) AS gap FROM f)
       SELECT count(gap) AS n, round(quantile_cont(gap, 0.1), 3) AS p10, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.9), 3) AS p90 FROM g"""),
)
def _(v: Views) -> DataFrame:
    """Percentiles of consecutive first sights."""
    return relay.noise_floor(v.hops).select("n", _r("p10", 3), _r("p50", 3), _r("p90", 3))


@query(
    "q_timing_signature",
    with_("ev", body=""" , g AS (SELECT peer, ts - lag(ts) OVER (PARTITION BY peer, event_type ORDER BY ts, txid) AS gap FROM ev), s AS (SELECT peer, count(*) AS n, round(avg(gap), 3) AS gap_mean, round(median(gap), 3) AS gap_median FROM g GROUP BY 1 HAVING count(*) >= 20),
       h AS (SELECT peer, CAST(floor((ts % 86400) / 3600) AS INT) AS hour, count(*) AS k FROM ev GROUP BY 1, 2)
       SELECT s.*, (SELECT hour FROM h WHERE h.peer = s.peer ORDER BY k DESC, hour LIMIT 1) AS busiest_hour FROM s"""),
)
def _(v: Views) -> DataFrame:
    """Gaps within a vantage and the busiest hour."""
    return relay.timing_signature(v.seen).select("peer", "n", _r("gap_mean", 3), _r("gap_median", 3), "busiest_hour")


def _observations(v: Views) -> DataFrame:
    return v.orders.select(
        F.concat(F.lit("C"), "o_custkey").alias("entity"), F.concat(F.lit("P"), F.col("o_orderkey") % 97).alias("ip"), F.concat(F.lit("T"), "o_orderkey").alias("txid"),
        (F.col("o_orderkey") % 10 / 10.0).alias("confidence"), (F.col("o_orderkey") % 97 < 9).alias("masked"),
    )


_LINKS = """WITH ob AS (SELECT 'C' || o_custkey AS entity, 'P' || (o_orderkey % 97) AS ip, (o_orderkey % 10) / 10.0 AS c, o_orderkey % 97 < 9 AS m FROM orders), l AS (SELECT entity, ip, count(*) AS txs, sum(c) AS eff, bool_or(m) AS m FROM ob GROUP BY 1, 2), s AS (SELECT ip, count(*) AS entities FROM l GROUP BY 1),
  k AS (SELECT entity, ip, txs, round(eff, 6) AS effective, entities, CASE WHEN m THEN 0.2 ELSE 1.0 END AS asn_penalty, CASE WHEN entities <= 3 THEN 1.0 ELSE greatest(0.02, 3.0 / entities) END AS shared_penalty,
        (1 - exp(-eff / 2.0)) * CASE WHEN m THEN 0.2 ELSE 1.0 END * CASE WHEN entities <= 3 THEN 1.0 ELSE greatest(0.02, 3.0 / entities) END AS score FROM l JOIN s USING (ip))"""


@query("q_links", _LINKS + " SELECT entity, ip, txs, effective, entities, CAST(asn_penalty AS DOUBLE) AS asn_penalty, round(CAST(shared_penalty AS DOUBLE), 6) AS shared_penalty, round(CAST(score AS DOUBLE), 6) AS score FROM k")
def _(v: Views) -> DataFrame:
    """Lead scores with penalties."""
    rows = scoring.links(_observations(v))
    return rows.select("entity", "ip", "txs", _r("effective"), "entities", "asn_penalty", _r("shared_penalty"), _r("score"))


@query("q_top_leads", _LINKS + " SELECT entity, ip, place FROM (SELECT entity, ip, row_number() OVER (PARTITION BY entity ORDER BY round(CAST(score AS DOUBLE), 9) DESC, ip) AS place FROM k) WHERE place <= 3")
def _(v: Views) -> DataFrame:
    """The three best leads of each entity."""
    return scoring.top_leads(scoring.links(_observations(v)).withColumn("score", F.round("score", 9))).select("entity", "ip", "place")


@query(
    "q_peer_profiles",
    with_("ev", body=""" SELECT peer, count(*) AS n, count(DISTINCT txid) AS txs, count(DISTINCT event_type) AS vantages, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high FROM ev GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """Profiles of all peers at once."""
    return v.events.groupBy("peer").agg(
        F.count("*").alias("n"), F.countDistinct("txid").alias("txs"), F.countDistinct("event_type").alias("vantages"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.when(F.col("value") > 50, 1)).alias("high"),
    )


@query("q_stream_dedup", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """Arrivals in several files, a third of the events coming twice, in other batches too: each id once (Q1, Q2, Q3)."""
    from tracewright.session import shared_dir
    from tracewright.streaming import arrivals

    at = f"{shared_dir(v.spark)}/inbox-{uuid.uuid4().hex}"
    events = v.table("events")
    events.repartition(3, "event_type").write.parquet(at)
    events.where("event_id % 3 = 0").repartition(2, "event_id").write.mode("append").parquet(at)
    rows = arrivals.drained(v.spark, at, events.schema, key="event_id")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("q_stream_windows", with_("ev", body=""" SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM ev GROUP BY 1, 2"""))
def _(v: Views) -> DataFrame:
    """Event-time windows of all arrivals, late ones too, as a stream (E3 streaming form)."""
    from tracewright.streaming import arrivals

    return arrivals.windowed(v.spark, f"{v.dir}/events.parquet", v.table("events").schema)


@query("q_staged_arrivals", """WITH u AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events WHERE value >= 0 GROUP BY 1)
   SELECT 'U' || user_id AS subject, n, v > 3000 AS alerted FROM u""")
def _(v: Views) -> DataFrame:
    """Files taken in two phases, a third of the events in them twice: rows once, each alert raised once (Q2, Q3, Q5)."""
    from tracewright.session import shared_dir
    from tracewright.streaming import staged

    at = f"{shared_dir(v.spark)}/staged-{uuid.uuid4().hex}"
    events = v.table("events").where("value >= 0").select("event_id", "user_id", "value")
    events.repartition(2, "event_id").write.parquet(f"{at}/inbox")
    events.where("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{at}/inbox")

    def score(new: DataFrame, known: DataFrame) -> DataFrame:
        rows = new.select("user_id", "value", F.lit(0).alias("old")).unionByName(known.select("user_id", "value", F.lit(1).alias("old")))
        sums = rows.groupBy("user_id").agg(F.sum("value").alias("now"), F.coalesce(F.sum(F.when(F.col("old") == 1, F.col("value"))), F.lit(0.0)).alias("before"))
        return sums.where("now > 3000 and not before > 3000").select(F.concat(F.lit("U"), "user_id").alias("subject"), F.col("now").alias("detail"))

    box = staged.Inbox(v.spark, f"{at}/inbox", f"{at}/case", events.schema, "event_id", score, files=2).drain()
    raised = box.alerts().groupBy("subject").agg(F.count("*").alias("times"))
    rows = box.rows().groupBy(F.concat(F.lit("U"), "user_id").alias("subject")).agg(F.count("*").alias("n"))
    return rows.join(raised, "subject", "left").select("subject", "n", (F.coalesce("times", F.lit(0)) == 1).alias("alerted"))
