"""Evaluation reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import metrics, reports
from tracewright.operators import relay
from tracewright.plans.adapters import Views, with_
from tracewright.plans.registry import query


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


_NODES = """ , nd AS (SELECT txid, ip, min(ts) AS a FROM (SELECT txid, src AS ip, ts FROM hops UNION ALL SELECT txid, dst, ts FROM hops) GROUP BY 1, 2)"""


@query("q_ceiling", with_("ev", "hops", body=_NODES + """ , tr AS (SELECT txid, max(peer) AS ip FROM ev GROUP BY 1), h AS (SELECT n, CASE WHEN nd.ip IS NULL THEN 0.0 ELSE 1.0 END AS hit FROM tr JOIN (SELECT txid, count(*) AS n FROM nd GROUP BY 1) USING (txid) LEFT JOIN nd USING (txid, ip))
       SELECT round(avg(hit), 6) AS "all", round(avg(hit) FILTER (WHERE n > 1), 6) AS multi, count(*) AS n_all, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_multi FROM h"""))
def _(v: Views) -> DataFrame:
    """How often the true origin can be found at all."""
    truth = v.seen.groupBy("txid").agg(F.max("peer").alias("ip"))
    return reports.ceiling(truth, relay.tree_nodes(v.hops)).select(_r("all"), _r("multi"), "n_all", "n_multi")


@query("q_cases", """WITH ac AS (SELECT o_custkey % 90 AS actor, o_orderpriority AS typology, o_custkey AS entity FROM orders), al AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_totalprice > 300000), re AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_totalprice > 200000),
       p AS (SELECT typology, actor, max(CAST(al.entity IS NOT NULL AS INT)) AS hit, avg(CASE WHEN re.entity IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM ac LEFT JOIN al USING (entity) LEFT JOIN re USING (entity) GROUP BY 1, 2) SELECT typology, count(*) AS cases, CAST(sum(hit) AS BIGINT) AS detected, round(avg(share), 6) AS coverage FROM p GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """Cases detected and covered, by kind."""
    o = v.orders.withColumn("entity", F.col("o_custkey"))
    actors = o.select((F.col("o_custkey") % 90).alias("actor"), F.col("o_orderpriority").alias("typology"), "entity")
    return reports.cases(actors, o.where("o_totalprice > 300000"), o.where("o_totalprice > 200000")).select("typology", "cases", "detected", _r("coverage"))


@query("q_broadcast_truth", "SELECT coalesce('N' || (CASE WHEN c_acctbal > 0 THEN c_nationkey END), 'A' || o_custkey) AS entity, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS ips FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(v: Views) -> DataFrame:
    """Who broadcast for an entity."""
    members = v.table("customer").where("c_acctbal > 0").select(F.concat(F.lit("A"), "c_custkey").alias("node"), F.concat(F.lit("N"), "c_nationkey").alias("component"))
    return reports.broadcast_truth(v.orders.select(F.col("o_orderkey").alias("txid"), F.concat(F.lit("A"), "o_custkey").alias("entity"), F.col("o_orderpriority").alias("ip")), members)


_LEADS = """WITH ld AS (SELECT user_id AS entity, event_type AS ip, count(*) AS txs, 1 - exp(-count(*) / 5.0) AS score FROM events GROUP BY 1, 2), tt AS (SELECT DISTINCT user_id AS entity, event_type AS ip FROM events WHERE event_id % 3 = 0),
  lp AS (SELECT ld.*, CAST(tt.ip IS NOT NULL AS INT) AS ok, row_number() OVER (PARTITION BY entity ORDER BY score DESC, ld.ip) AS place FROM ld LEFT JOIN tt USING (entity, ip))"""


def _leads(v: Views) -> tuple[DataFrame, DataFrame]:
    e = v.table("events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("ip"), "event_id")
    return e.groupBy("entity", "ip").agg(F.count("*").alias("txs"), (1 - F.exp(-F.count("*") / 5.0)).alias("score")), e.where("event_id % 3 = 0")


@query("q_lead_precision", _LEADS + """ , x AS (SELECT ok, unnest([{'by': 'score', 'part': CASE WHEN score < 0.25 THEN '<0.25' WHEN score < 0.5 THEN '<0.5' WHEN score < 0.75 THEN '<0.75' ELSE '>=0.75' END}, {'by': 'observations', 'part': CASE WHEN txs = 1 THEN '1' WHEN txs <= 4 THEN '2-4' ELSE '5+' END}, {'by': 'place', 'part': CAST(place AS VARCHAR)}]) AS u FROM lp)
       SELECT u."by" AS "by", u.part AS part, count(*) AS n, CAST(sum(ok) AS BIGINT) AS "right", round(avg(ok), 6) AS precision FROM x GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    """Leads that name the truth, by band, count and place (P10)."""
    return reports.lead_precision(*_leads(v)).select("by", "part", "n", "right", _r("precision"))


@query("q_first_hit", _LEADS + " SELECT entity, min(place) AS n FROM lp WHERE ok = 1 GROUP BY 1")
def _(v: Views) -> DataFrame:
    """Leads read until the first right one."""
    leads, truth = _leads(v)
    rows = leads.join(truth.select("entity", "ip").distinct().withColumn("ok", F.lit(1)), ["entity", "ip"], "left")
    return reports.first_hit(rows, "entity", [F.col("score").desc(), F.col("ip")], F.col("ok") == 1).select("entity", F.col("n").cast("long").alias("n"))


@query("q_saturation", """WITH q AS (SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000.0)), 10) AS risk, c_nationkey AS hops, c_mktsegment AS kind FROM customer), k AS (SELECT count(*) AS keys, max(k) AS largest FROM (SELECT count(*) AS k FROM q GROUP BY round(risk, 2), hops, kind))
       SELECT count(*) AS n, count(DISTINCT risk) AS scores, count(DISTINCT round(risk, 4)) AS shown, CAST(count(*) FILTER (WHERE risk = (SELECT max(risk) FROM q)) AS BIGINT) AS at_top, any_value(keys) AS keys, any_value(largest) AS largest FROM q, k""")
def _(v: Views) -> DataFrame:
    """How well scores tell alerts apart."""
    q = v.table("customer").select(F.round(1 / (1 + F.exp(-F.col("c_acctbal") / 1000.0)), 10).alias("risk"), F.col("c_nationkey").alias("hops"), F.col("c_mktsegment").alias("kind"))
    return reports.saturation(q.withColumn("coarse", F.round("risk", 2)), "risk", ["coarse", "hops", "kind"])


_ALERTS = """WITH sg AS (SELECT round(c_acctbal / 5000.0, 1) AS taint, CASE WHEN c_custkey % 4 > 0 THEN (c_nationkey % 5) / 4.0 END AS rules, least(length(c_mktsegment) / 9.0, 1.0) AS anomaly FROM customer),
  al AS (SELECT *, 1 / (1 + exp(-logit)) AS score FROM (SELECT *, -1.0 + coalesce(taint, 0) * 4 + coalesce(rules, 0) * 2 + coalesce(anomaly, 0) * 1.5 AS logit FROM sg) WHERE 1 / (1 + exp(-logit)) >= 0.6)"""
_WEIGHTS = {"taint": 4.0, "rules": 2.0, "anomaly": 1.5}


def _alerts(v: Views) -> DataFrame:
    c, share = v.table("customer"), F.col("c_nationkey") % 5 / 4.0
    rows = c.select(F.round(F.col("c_acctbal") / 5000.0, 1).alias("taint"), F.when(F.col("c_custkey") % 4 > 0, share).alias("rules"), F.least(F.length("c_mktsegment") / 9.0, F.lit(1.0)).alias("anomaly"))
    return reports.alerts_of(rows, _WEIGHTS, -1.0, 0.6)


@query("q_saturation_causes", _ALERTS + """ , r AS (SELECT round(taint, 6) AS t, round(rules, 6) AS u, round(anomaly, 6) AS a, round(score, 3) AS shown, logit FROM al), ce AS (SELECT t, u, a, shown, count(*) AS n, min(logit) AS lo, max(logit) AS hi FROM r GROUP BY ALL), sh AS (SELECT shown, count(*) AS vectors, sum(n) AS everyone FROM ce GROUP BY 1), ve AS (SELECT sum(n) AS n FROM ce GROUP BY t, u, a),
  tc AS (SELECT *, CASE WHEN everyone = 1 THEN 'own' WHEN n > 1 THEN 'equal' WHEN lo >= 7.6 THEN 'capped' ELSE 'rounded' END AS cause FROM ce JOIN sh USING (shown))
       SELECT (SELECT count(*) FROM r) AS alerts, (SELECT count(*) FROM sh) AS shown, (SELECT CAST(sum(vectors - 1) AS BIGINT) FROM sh) AS collapsed, (SELECT count(*) FROM ve) AS vectors, (SELECT CAST(max(n) AS BIGINT) FROM ve) AS largest, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ve WHERE n > 1) AS sharing, (SELECT count(*) FROM r WHERE logit >= 7.6) AS above_flat, (SELECT count(DISTINCT round(logit, 6)) FROM r) AS logits, round(min(lo), 6) AS logit_min, round(max(hi), 6) AS logit_max,
       CAST(coalesce(sum(n) FILTER (WHERE cause = 'own'), 0) AS BIGINT) AS own_score, CAST(coalesce(sum(n) FILTER (WHERE cause = 'equal'), 0) AS BIGINT) AS equal_inputs, CAST(coalesce(sum(n) FILTER (WHERE cause = 'capped'), 0) AS BIGINT) AS capped, CAST(coalesce(sum(n) FILTER (WHERE cause = 'rounded'), 0) AS BIGINT) AS rounded FROM tc""")
def _(v: Views) -> DataFrame:
    """Why alerts share a score: equal inputs, a flat score, or rounding."""
    got = reports.diagnosis(_alerts(v), list(_WEIGHTS))
    return got.withColumns({c: F.round(c, 6) for c in ("logit_min", "logit_max")})


@query("q_input_spread", _ALERTS + """ , p AS (SELECT 'taint' AS signal, taint AS v FROM al UNION ALL SELECT 'rules', rules FROM al UNION ALL SELECT 'anomaly', anomaly FROM al), q AS (SELECT *, max(v) OVER (PARTITION BY signal) AS top FROM p WHERE v IS NOT NULL)
       SELECT signal, round(min(v), 6) AS min, round(median(v), 6) AS median, round(max(v), 6) AS max, count(DISTINCT round(v, 6)) AS "distinct", CAST(count(*) FILTER (WHERE v >= top - 1e-9) AS BIGINT) AS at_max, CAST(count(*) FILTER (WHERE v <= 1e-12) AS BIGINT) AS zero FROM q GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """Each signal among alerts: its range, and how often it is full or empty."""
    return reports.input_spread(_alerts(v), list(_WEIGHTS)).select("signal", _r("min"), _r("median"), _r("max"), "distinct", "at_max", "zero")


@query("q_logit_deciles", _ALERTS + """ , l AS (SELECT list(logit ORDER BY logit) AS z FROM al) SELECT CAST(k AS INT) AS decile, round(z[CAST(round_even((len(z) - 1) * k / 10.0, 0) AS BIGINT) + 1], 6) AS logit, round(1 / (1 + exp(-z[CAST(round_even((len(z) - 1) * k / 10.0, 0) AS BIGINT) + 1])), 3) AS shown FROM l, range(11) AS t(k)""")
def _(v: Views) -> DataFrame:
    """The linear score's tenths, as values that alerts have, and what is shown of them."""
    d = reports.nearest_deciles(_alerts(v), "logit")
    return d.select("decile", F.round("value", 6).alias("logit"), F.round(1 / (1 + F.exp(-F.col("value"))), 3).alias("shown"))


@query("q_deciles", "WITH a AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders) SELECT CAST(k - 1 AS INT) AS decile, round(q[k], 4) AS value FROM a, range(1, 12) AS t(k)")
def _(v: Views) -> DataFrame:
    """Exact deciles without one ordered task."""
    return reports.deciles(v.orders, "o_totalprice").select("decile", _r("value", 4))


_WORLD = "WITH w AS (SELECT o_custkey AS entity, max(o_totalprice) / 600000.0 AS rules, (o_custkey % 10) / 10.0 AS taint, (o_custkey % 7) / 9.0 AS anomaly FROM orders GROUP BY 1), s AS (SELECT *, 0.5 * rules + 0.3 * taint + 0.2 * anomaly AS risk FROM w)"


@query("q_false_alarms", _WORLD + """ , l AS (SELECT risk, risk >= 0.45 AS over_, CASE WHEN rules = greatest(rules, taint, anomaly) THEN 'rules' WHEN taint = greatest(rules, taint, anomaly) THEN 'taint' ELSE 'anomaly' END AS led FROM s)
       SELECT CAST(least(floor(risk * 10), 9) AS INT) AS band, count(*) AS n, CAST(count(*) FILTER (WHERE over_) AS BIGINT) AS "over", CAST(count(*) FILTER (WHERE over_ AND led = 'rules') AS BIGINT) AS led_rules, CAST(count(*) FILTER (WHERE over_ AND led = 'taint') AS BIGINT) AS led_taint, CAST(count(*) FILTER (WHERE over_ AND led = 'anomaly') AS BIGINT) AS led_anomaly FROM l GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """False alarms and what raised them."""
    e = F.col("entity")
    w = v.orders.groupBy(F.col("o_custkey").alias("entity")).agg((F.max("o_totalprice") / 600000.0).alias("rules")).withColumns({"taint": e % 10 / 10.0, "anomaly": e % 7 / 9.0})
    return reports.false_alarms(w.withColumn("risk", 0.5 * F.col("rules") + 0.3 * F.col("taint") + 0.2 * F.col("anomaly")), 0.45, ["rules", "taint", "anomaly"])


@query("q_runs", """SELECT o_orderpriority AS kind, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderkey % 3 > 0) AS BIGINT) AS detected, round(avg(CAST(o_orderkey % 3 > 0 AS INT)), 6) AS rate, round(median(o_totalprice), 4) AS seconds, round(median(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 17 END), 4) AS to_detect FROM orders GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """A batch of trials by kind (P20)."""
    hit = F.col("o_orderkey") % 3 > 0
    rows = v.orders.select(F.col("o_orderpriority").alias("kind"), hit.alias("detected"), F.col("o_totalprice").alias("seconds"), F.when(hit, F.col("o_orderkey") % 17).alias("to_detect"))
    return reports.runs(rows, "kind").select("kind", "n", "detected", _r("rate"), _r("seconds", 4), _r("to_detect", 4))


@query("q_class_rates", """WITH p AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS g FROM lineitem), t AS (SELECT y AS label, count(*) AS n, count(*) FILTER (WHERE y = g) AS r FROM p GROUP BY 1), u AS (SELECT g AS label, count(*) AS told FROM p GROUP BY 1)
       SELECT label, coalesce(n, 0) AS n, coalesce(told, 0) AS told, CAST(coalesce(r, 0) AS BIGINT) AS "right", round(r / told, 6) AS precision, round(r / n, 6) AS recall FROM t FULL JOIN u USING (label)""")
def _(v: Views) -> DataFrame:
    """Precision and recall of each class."""
    q = F.col("l_quantity")
    return reports.class_rates(v.table("lineitem").select(F.col("l_returnflag").alias("y"), F.when(q < 15, "A").when(q < 30, "N").otherwise("R").alias("g")), "y", "g").select("label", "n", "told", "right", _r("precision"), _r("recall"))


@query("q_estimator_cross", with_("ev", "hops", body=_NODES + """ , e2 AS (SELECT txid, src AS ip, ts, ts AS sent FROM hops UNION ALL SELECT txid, dst, ts, NULL FROM hops), n2 AS (SELECT txid, ip, min(ts) AS a, min(sent) AS b FROM e2 GROUP BY 1, 2), f AS (SELECT txid, ip, row_number() OVER (PARTITION BY txid ORDER BY a, CASE WHEN b = a THEN 0 ELSE 1 END, ip) AS k1, row_number() OVER (PARTITION BY txid ORDER BY a DESC, ip) AS k2 FROM n2), tr AS (SELECT txid, max(peer) AS ip FROM ev GROUP BY 1)
       SELECT r AS estimator, m AS filter, count(*) AS n, round(avg(CAST(f.ip = tr.ip AS INT)), 6) AS top1 FROM f JOIN tr USING (txid), (VALUES ('first'), ('last')) AS a(r), (VALUES ('off'), ('odd')) AS b(m) WHERE (r = 'first' AND k1 = 1 OR r = 'last' AND k2 = 1) AND (m = 'off' OR CAST(substr(f.ip, 2) AS BIGINT) % 2 = 1) GROUP BY 1, 2"""))
def _(v: Views) -> DataFrame:
    """Estimators crossed with filters, as one table of runs."""
    nodes = relay.tree_nodes(v.hops)
    first = relay.first_timestamp(nodes).where("place = 0").select("txid", "ip")
    last = nodes.groupBy("txid").agg(F.min_by("ip", F.struct(-F.col("first_seen"), "ip")).alias("ip"))
    truth = v.seen.groupBy("txid").agg(F.max("peer").alias("true"))

    def run(rows: DataFrame, odd: bool) -> DataFrame:
        rows = rows.where(F.substring("ip", 2, 12).cast("long") % 2 == 1) if odd else rows
        return rows.join(truth, "txid").agg(F.count("*").alias("n"), F.round(F.avg((F.col("ip") == F.col("true")).cast("double")), 6).alias("top1"))

    return reports.crossed({(n, f): run(rows, f == "odd") for n, rows in (("first", first), ("last", last)) for f in ("off", "odd")}, ("estimator", "filter"))


@query("q_tag_bound", _WORLD + " SELECT count(*) AS n, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS after, CAST(count(*) FILTER (WHERE NOT a AND b) AS BIGINT) AS gained, CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS lost FROM (SELECT risk >= 0.45 AS a, greatest(risk, CASE WHEN entity % 11 = 0 THEN 1.0 ELSE 0.0 END) >= 0.45 AS b FROM s)")
def _(v: Views) -> DataFrame:
    """Detection with and without a source of tags."""
    e = F.col("entity")
    w = v.orders.groupBy(F.col("o_custkey").alias("entity")).agg((F.max("o_totalprice") / 600000.0).alias("rules"))
    w = w.withColumn("risk", 0.5 * F.col("rules") + 0.3 * (e % 10 / 10.0) + 0.2 * (e % 7 / 9.0))
    tagged = w.withColumn("risk", F.greatest("risk", F.when(e % 11 == 0, 1.0).otherwise(0.0)))
    flag = lambda d: d.select("entity", (F.col("risk") >= 0.45).alias("hit"))
    return reports.compared(flag(w), flag(tagged), "entity", "hit")


@query("q_exit_scores", """WITH r AS (SELECT o_custkey % 40 AS seed, o_orderpriority AS node, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2), k AS (SELECT *, x / sum(x) OVER (PARTITION BY seed) AS share, row_number() OVER (PARTITION BY seed ORDER BY x DESC, node) AS rank FROM r), t AS (SELECT DISTINCT o_custkey % 50 AS seed, o_orderpriority AS node FROM orders WHERE o_orderkey % 97 = 0),
       p AS (SELECT t.seed, max(CAST(coalesce(rank = 1, false) AS INT)) AS a, max(CAST(coalesce(rank <= 3, false) AS INT)) AS b, sum(coalesce(share, 0)) AS s FROM t LEFT JOIN k USING (seed, node) GROUP BY 1) SELECT count(*) AS seeds, round(avg(a), 6) AS top1, round(avg(b), 6) AS top3, round(avg(s), 6) AS mean_share FROM p""")
def _(v: Views) -> DataFrame:
    """Exit points against the true ones, over many seeds."""
    r = v.orders.groupBy((F.col("o_custkey") % 40).alias("seed"), F.col("o_orderpriority").alias("node")).agg(F.sum("o_totalprice").alias("x"))
    w = Window.partitionBy("seed")
    r = r.select("seed", "node", (F.col("x") / F.sum("x").over(w)).alias("share"), F.row_number().over(w.orderBy(F.col("x").desc(), "node")).alias("rank"))
    return reports.exit_scores(r, v.orders.where("o_orderkey % 97 = 0").select((F.col("o_custkey") % 50).alias("seed"), F.col("o_orderpriority").alias("node"))).select("seeds", _r("top1"), _r("top3"), _r("mean_share"))


@query("q_pattern_counts", "WITH a AS (SELECT c_acctbal / 10000.0 AS risk, CASE WHEN c_custkey % 4 = 0 THEN [NULL] WHEN c_custkey % 4 = 1 THEN [c_mktsegment] ELSE [c_mktsegment, 'wide'] END AS p FROM customer) SELECT coalesce(u, 'none') AS pattern, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM (SELECT risk, unnest(p) AS u FROM a) GROUP BY 1")
def _(v: Views) -> DataFrame:
    """Alerts by pattern."""
    k, m = F.col("c_custkey") % 4, F.col("c_mktsegment")
    rows = v.table("customer").select((F.col("c_acctbal") / 10000.0).alias("risk"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(m)).otherwise(F.array(m, F.lit("wide"))).alias("patterns"))
    return reports.pattern_counts(rows).select("pattern", "n", _r("mean_risk"))


@query("q_pooled_edges", """WITH e AS (SELECT l_orderkey AS t, 'S' || l_suppkey AS a, 'P' || l_partkey AS b, l_discount AS s FROM lineitem), p AS (SELECT t, n, avg(s) AS s FROM (SELECT t, unnest([a, b]) AS n, s FROM e) GROUP BY 1, 2), m AS (SELECT 'P' || p_partkey AS n, p_brand AS c FROM part WHERE p_size > 20) SELECT coalesce(c, n) AS entity, round(avg(s), 9) AS mean, round(max(s), 6) AS most FROM p LEFT JOIN m USING (n) GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """Edge scores pooled over entities."""
    e = v.table("lineitem").select(F.col("l_orderkey").alias("txid"), F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_discount").alias("score"))
    m = v.table("part").where("p_size > 20").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("component"))
    return reports.pooled_edges(e, m).select("entity", _r("mean", 9), _r("most"))


@query("q_standardised", "SELECT c_custkey AS k, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS x, 0.0 AS y FROM customer")
def _(v: Views) -> DataFrame:
    """Columns standardised, constants left at 0."""
    rows = v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.lit(4.0).alias("y"))
    return reports.standardised(rows, ["x", "y"]).select("k", _r("x"), _r("y"))


@query("q_providers", with_("cap", body=""" , p AS (SELECT peer_id, any_value(CASE WHEN peer_id % 5 > 0 THEN peer_id % 9 END) AS asn, count(*) AS n, count(*) FILTER (WHERE message_type = 'tx') AS f, any_value(user_agent) AS ag, min(ts) AS a, max(ts) AS b FROM cap GROUP BY 1)
       SELECT asn, count(*) AS peers, CAST(sum(n) AS BIGINT) AS announcements, CAST(sum(f) AS BIGINT) AS firsts, count(DISTINCT ag) AS agents, min(a) AS first_seen, max(b) AS last_seen FROM p WHERE asn IS NOT NULL GROUP BY 1"""))
def _(v: Views) -> DataFrame:
    """Networks by their member peers."""
    asn = F.when(F.col("peer_id") % 5 > 0, F.col("peer_id") % 9)
    peers = v.captured.withColumn("asn", asn).groupBy("peer_id").agg(F.max("asn").alias("asn"), F.count("*").alias("n"), F.sum((F.col("message_type") == "tx").cast("long")).alias("firsts"), F.max("user_agent").alias("agent"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return reports.provider_rollup(peers)


@query("q_first_known", "SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority LIKE '1%') AS a, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 250000) AS b FROM orders GROUP BY 1")
def _(v: Views) -> DataFrame:
    """First values that are not null."""
    rows = v.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("a"), F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice")).alias("b"))
    return reports.first_known(rows, "k", "o_orderkey", "a", "b")


@query("q_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def _(v: Views) -> DataFrame:
    """Places in a total order, dealt out by ranges."""
    return metrics.placed(v.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "place")
