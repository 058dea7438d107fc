"""Ingest, collapse, joins, aggregations and features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT
from tracewright.operators import ledger
from tracewright.operators.components import components
from tracewright.plans.adapters import Views, with_
from tracewright.plans.registry import query
from tracewright.sources import records


def _r(c, n=4):
    return F.round(c, n)


@query(
    "q_ingest_validation",
    """WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n,
         concat_ws('; ', CASE WHEN l_quantity > 45 THEN 'port out of range' END, CASE WHEN l_discount = 0 THEN 'bad IP' END, CASE WHEN l_tax >= 0.08 THEN 'negative amount' END) AS reason FROM lineitem)
       SELECT CASE WHEN reason = '' THEN 'good' ELSE 'bad' END AS side, reason, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM v GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    """Validation to reasons and the quarantine split."""
    checks = [("port out of range", F.col("l_quantity") <= 45), ("bad IP", F.col("l_discount") != 0), ("negative amount", F.col("l_tax") < 0.08)]
    rows = records.with_reasons(v.table("lineitem"), checks)
    good, bad = records.split(rows)
    sides = good.withColumn("side", F.lit("good")).unionByName(bad.withColumn("side", F.lit("bad")))
    return sides.groupBy("side", "reason").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "q_collapse",
    """WITH r AS (SELECT 'T' || l_orderkey AS txid, (l_linenumber, l_suppkey, l_quantity) AS o, 'S' || l_suppkey AS ip, l_quantity AS q FROM lineitem),
       p AS (SELECT txid, ip, min(o) AS seen_at FROM r GROUP BY 1, 2)
       SELECT txid, (SELECT arg_min(q, o) FROM r r2 WHERE r2.txid = r.txid) AS first_q, count(*) AS n_rows,
              (SELECT string_agg(ip, ',' ORDER BY seen_at, ip) FROM p WHERE p.txid = r.txid) AS ips FROM r GROUP BY txid""",
)
def _(v: Views) -> DataFrame:
    """Relay rows to transactions: first row, ordered distinct IPs."""
    rows = v.table("lineitem").select(F.concat(F.lit("T"), "l_orderkey").alias("txid"), F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("_src_row"), F.concat(F.lit("S"), "l_suppkey").alias("src_ip"), F.col("l_quantity").alias("first_q"))
    return ledger.collapse(rows).select("txid", "first_q", "n_rows", F.array_join("ips", ",").alias("ips"))


@query("q_graph_summary", with_("ins", "outs", body=" SELECT kind, count(*) AS n, round(sum(value), 0) AS value FROM (SELECT 'in' AS kind, value FROM ins UNION ALL SELECT 'out', value FROM outs) GROUP BY 1"))
def _(v: Views) -> DataFrame:
    """Wallet graph edges by kind."""
    return ledger.edges(v.ins, v.outs).groupBy("kind").agg(F.count("*").alias("n"), _r(F.sum("value"), 0).alias("value"))


@query(
    "q_script_types",
    """WITH a AS (SELECT list_extract(['bc1p', 'bc1q', 'tb1q', '3', '2', '1', 'm', 'n', 'x'], CAST(p_partkey % 9 + 1 AS INTEGER)) || repeat('q', CAST(p_size AS INTEGER)) AS addr FROM part)
       SELECT CASE WHEN addr LIKE 'bc1q%' AND length(addr) > 50 THEN 'p2wsh' WHEN addr LIKE 'bc1p%' THEN 'p2tr' WHEN addr LIKE 'bc1q%' OR addr LIKE 'tb1q%' THEN 'p2wpkh'
                   WHEN addr LIKE '3%' OR addr LIKE '2%' THEN 'p2sh' WHEN addr LIKE '1%' OR addr LIKE 'm%' OR addr LIKE 'n%' THEN 'p2pkh' ELSE '' END AS kind, count(*) AS n
       FROM a GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    """Script types by address prefix."""
    head = F.element_at(F.array(*[F.lit(x) for x in ("bc1p", "bc1q", "tb1q", "3", "2", "1", "m", "n", "x")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = v.table("part").select(F.concat(head, F.repeat(F.lit("q"), F.col("p_size").cast("int"))).alias("addr"))
    return rows.groupBy(ledger.script_type(F.col("addr")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "q_equal_outputs",
    with_("quant", body=""" , g AS (SELECT a.txid, a.idx, a.value, (SELECT count(*) FROM quant b WHERE b.txid = a.txid AND abs(b.value - a.value) <= 0.02 * greatest(a.value, 1e-12)) AS n FROM quant a),
       b AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY n DESC, idx, value) AS r FROM g)
       SELECT b.txid, n AS equal_outputs, value AS group_value, (SELECT count(*) FROM quant q WHERE q.txid = b.txid) AS n_out FROM b WHERE r = 1 AND n >= 3"""),
)
def _(v: Views) -> DataFrame:
    """The largest near-equal group of outputs."""
    f = ledger.tx_features(v.txs, v.ins, v.quantities)
    rows = f.where("equal_outputs >= 3").select("txid", "equal_outputs", "n_out")
    g = v.quantities.groupBy("txid").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("vs"))
    g = g.select("txid", ledger.equal_group(F.col("vs"), 0.02)["value"].alias("group_value"))
    return rows.join(g, "txid").select("txid", F.col("equal_outputs").cast("long").alias("equal_outputs"), "group_value", F.col("n_out").cast("long").alias("n_out"))


@query(
    "q_coinjoin_exclusion",
    with_("quant", "tx", body=""" , pairs AS (SELECT txid, max(c) AS c, count(*) AS n FROM (SELECT a.txid, a.idx, (SELECT count(*) FROM quant b WHERE b.txid = a.txid AND abs(b.value - a.value) <= 0.02 * greatest(a.value, 1e-12)) AS c FROM quant a) GROUP BY 1)
       SELECT count(*) AS kept, CAST(round(sum(ts)) AS BIGINT) AS ts FROM tx WHERE txid NOT IN (SELECT txid FROM pairs WHERE c >= 3 AND n >= 3)"""),
)
def _(v: Views) -> DataFrame:
    """Anti join on mixes."""
    mixes = ledger.tx_features(v.txs, v.ins, v.quantities).where("equal_outputs >= 3 and n_out >= 3").select("txid")
    return v.txs.join(mixes, "txid", "left_anti").agg(F.count("*").alias("kept"), F.round(F.sum("ts")).cast("long").alias("ts"))


@query("q_round_amounts", """SELECT o_orderkey, round(o_totalprice, -1) AS v FROM orders WHERE round(o_totalprice) % 10 = 0""")
def _(v: Views) -> DataFrame:
    """Round amounts."""
    c = replace(DEFAULT, round_units=(10.0,))
    return v.orders.where(ledger.round_amount(F.round("o_totalprice"), c)).select("o_orderkey", F.round("o_totalprice", -1).alias("v"))


@query(
    "q_first_spender",
    with_("ins", "outs", "tx", body=""" , s AS (SELECT addr, arg_min(txid, (ts, txid)) AS spender FROM ins JOIN tx USING (txid) GROUP BY 1)
       SELECT txid, idx, addr, spender FROM outs JOIN s USING (addr)"""),
)
def _(v: Views) -> DataFrame:
    """Outputs and the first transaction that spends from their address."""
    s = ledger.first_spender(v.ins, v.txs).select("addr", F.col("txid").alias("spender"))
    return v.outs.select("txid", "idx", "addr").join(s, "addr")


@query(
    "q_entity_of",
    f"""WITH m AS (SELECT 'A' || c_custkey AS addr, min('N' || c_nationkey) AS c FROM customer WHERE c_acctbal > 0 GROUP BY 1), o AS (SELECT 'A' || o_custkey AS addr, o_totalprice AS value FROM orders)
       SELECT coalesce(c, o.addr) AS entity, count(*) AS n, round(sum(value), 0) AS value FROM o LEFT JOIN m USING (addr) GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    """Address to entity with the address as default."""
    m = v.table("customer").where("c_acctbal > 0").groupBy(F.concat(F.lit("A"), "c_custkey").alias("node")).agg(F.min(F.concat(F.lit("N"), "c_nationkey")).alias("component"))
    return ledger.named(v.ins, m).groupBy("entity").agg(F.count("*").alias("n"), _r(F.sum("value"), 0).alias("value"))


@query(
    "q_entity_rollup",
    with_("tx", "ins", "outs", body=""" , s AS (SELECT addr AS e, count(DISTINCT txid) AS txs_out, sum(value) AS value_out FROM ins GROUP BY 1), g AS (SELECT addr AS e, count(DISTINCT txid) AS txs_in, sum(value) AS value_in FROM outs GROUP BY 1),
       met AS (SELECT DISTINCT i.addr AS src, o.addr AS dst FROM ins i JOIN outs o USING (txid) WHERE i.addr <> o.addr), cto AS (SELECT src AS e, count(*) AS n FROM met GROUP BY 1), cof AS (SELECT dst AS e, count(*) AS n FROM met GROUP BY 1),
       life AS (SELECT e, min(ts) AS a, max(ts) AS b FROM (SELECT DISTINCT txid, addr AS e FROM ins UNION SELECT DISTINCT txid, addr FROM outs) JOIN tx USING (txid) GROUP BY 1)
       SELECT e AS entity, coalesce(txs_in, 0) AS txs_in, coalesce(txs_out, 0) AS txs_out, round(coalesce(value_in, 0), 0) AS value_in, round(coalesce(value_out, 0), 0) AS value_out,
              coalesce(cof.n, 0) AS counterparties_in, coalesce(cto.n, 0) AS counterparties_out, round((coalesce(txs_in, 0) + coalesce(txs_out, 0)) / greatest((b - a) / 86400.0, 1.0), 6) AS velocity,
              round(CASE WHEN coalesce(cof.n, 0) + coalesce(cto.n, 0) > 0 THEN coalesce(cof.n, 0) / (coalesce(cof.n, 0) + coalesce(cto.n, 0)) ELSE 0.0 END, 6) AS fan_in
       FROM life LEFT JOIN s USING (e) LEFT JOIN g USING (e) LEFT JOIN cto USING (e) LEFT JOIN cof USING (e)"""),
)
def _(v: Views) -> DataFrame:
    """Entity features."""
    rows = ledger.entity_rollup(v.ins, v.outs, v.txs)
    return rows.select(
        "entity", "txs_in", "txs_out", _r(F.col("value_in"), 0).alias("value_in"), _r(F.col("value_out"), 0).alias("value_out"), "counterparties_in", "counterparties_out",
        _r(F.col("velocity"), 6).alias("velocity"), _r(F.col("fan_in"), 6).alias("fan_in"),
    )


@query(
    "q_tx_features",
    with_("tx", "ins", "quant", body=""" SELECT txid, count(DISTINCT addr) AS n_out_addrs, count(*) AS n_out, round(sum(value), 2) AS out_value, round(CASE WHEN count(*) = 2 THEN min(value) / max(value) END, 6) AS peel_ratio FROM quant GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """Transaction features."""
    f = ledger.tx_features(v.txs, v.ins, v.quantities).where("n_out > 0")
    n = v.quantities.groupBy("txid").agg(F.countDistinct("addr").alias("n_out_addrs"))
    return f.join(n, "txid").select("txid", "n_out_addrs", F.col("n_out").cast("long").alias("n_out"), _r(F.col("out_value"), 2).alias("out_value"), _r(F.col("peel_ratio"), 6).alias("peel_ratio"))


@query(
    "q_entity_edges",
    with_("ins", "outs", "tx", body=""" , i AS (SELECT txid, addr AS src, sum(value) AS sent FROM ins GROUP BY 1, 2), s AS (SELECT *, sent / sum(sent) OVER (PARTITION BY txid) AS share FROM i), o AS (SELECT txid, addr AS dst, sum(value) AS got FROM outs GROUP BY 1, 2)
       SELECT src, dst, round(sum(got * share), 4) AS value, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM s JOIN o USING (txid) JOIN tx USING (txid) WHERE src <> dst GROUP BY 1, 2"""),
)
def _(v: Views) -> DataFrame:
    """Entity graph edges."""
    rows = ledger.entity_edges(v.ins, v.outs, v.txs, v.txs.where("false"))
    return rows.select("src", "dst", _r(F.col("value"), 4).alias("value"), "n", "first_seen", "last_seen")


@query(
    "q_change_votes",
    with_("quant", body=f""" , i AS (SELECT 'T' || o_orderkey AS txid, 'A' || o_custkey AS a, 20.0 AS v FROM orders),
       f AS (SELECT q.*, i.a = q.addr AS reuse, q.value < i.v AS small, min(q.value < i.v) OVER (PARTITION BY q.txid) AS all_small, count(*) OVER (PARTITION BY q.txid) AS n FROM quant q JOIN i USING (txid)),
       w AS (SELECT *, CAST(reuse AS INT) + CAST(small AND NOT all_small AS INT) AS votes FROM f), m AS (SELECT *, max(votes) OVER (PARTITION BY txid) AS top FROM w), k AS (SELECT *, sum(CAST(votes = top AS INT)) OVER (PARTITION BY txid) AS winners FROM m)
       SELECT txid, idx, addr, votes FROM k WHERE votes = top AND winners = 1 AND votes >= 1 AND n >= 2"""),
)
def _(v: Views) -> DataFrame:
    """Change by a unique vote of heuristics."""
    return ledger.change_votes(v.txs, v.ins.withColumn("value", F.lit(20.0)), v.quantities, replace(DEFAULT, change_votes=1)).select("txid", "idx", "addr", F.col("votes").cast("int").alias("votes"))


@query(
    "q_last_use_gap",
    with_("ins", "tx", body=""" , u AS (SELECT DISTINCT addr, ts FROM ins JOIN tx USING (txid)), l AS (SELECT *, lag(ts) OVER (PARTITION BY addr ORDER BY ts) AS b FROM u)
       SELECT txid, min(t.ts - l.b) AS gap FROM ins JOIN tx t USING (txid) JOIN l ON l.addr = ins.addr AND l.ts = t.ts GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """Seconds since an input was last used, strictly before."""
    return ledger.last_use_gap(v.ins, v.txs)


@query(
    "q_dormancy_burst",
    with_("ev", body=""" , e AS (SELECT peer, CAST(floor(ts) AS BIGINT) AS ts FROM ev), g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY peer ORDER BY ts) AS gap, count(*) OVER (PARTITION BY peer ORDER BY ts RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS burst FROM e)
       SELECT peer, round(coalesce(max(gap) / 86400.0, 0.0), 6) AS max_gap, coalesce(max(burst) FILTER (WHERE gap >= 86400), 0) AS burst FROM g GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """The longest gap and the burst after a long one."""
    rows = ledger.dormancy(v.events.select("peer", F.floor("ts").alias("ts")), "peer", replace(DEFAULT, dormancy_days=1.0))
    return rows.select("peer", _r(F.col("max_gap"), 6).alias("max_gap"), "burst")


def _cluster_sql(rounds: int) -> str:
    """Least labels passed on through transactions, more rounds than these tables need."""
    steps = ["c0 AS (SELECT DISTINCT l_partkey AS p, l_partkey AS c FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1))"]
    for k in range(1, rounds + 1):
        steps.append(f"t{k} AS (SELECT l_orderkey AS t, min(c) AS c FROM lineitem JOIN c{k - 1} ON p = l_partkey GROUP BY 1)")
        steps.append(f"c{k} AS MATERIALIZED (SELECT l_partkey AS p, min(c) AS c FROM lineitem JOIN t{k} ON t = l_orderkey WHERE l_partkey IN (SELECT p FROM c0) GROUP BY 1)")
    return "WITH " + ",\n".join(steps) + f" SELECT p AS node, c AS component FROM c{rounds}"


@query(
    "q_clusters",
    _cluster_sql(10),
)
def _(v: Views) -> DataFrame:
    """Clusters by common ownership: connected components."""
    held = v.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("b"))
    # Each member joins the least of its transaction: as many links as members, not pairs.
    return components(held.withColumn("a", F.min("b").over(Window.partitionBy("l_orderkey"))).select("a", "b"))


@query(
    "q_pairs_capped",
    with_("ins", "outs", body=""" SELECT txid, src, dst, round(value, 4) AS value FROM (SELECT txid, i.addr AS src, o.addr AS dst, o.value, row_number() OVER (PARTITION BY txid ORDER BY o.value DESC, i.addr, o.addr, o.idx) AS r FROM ins i JOIN outs o USING (txid)) WHERE r <= 2"""),
)
def _(v: Views) -> DataFrame:
    """Input-output pairs of a transaction, the largest kept."""
    rows = v.ins.select("txid", F.col("addr").alias("src")).join(v.outs.select("txid", "idx", F.col("addr").alias("dst"), "value"), "txid")
    w = Window.partitionBy("txid").orderBy(F.col("value").desc(), "src", "dst", "idx")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 2").select("txid", "src", "dst", _r(F.col("value"), 4).alias("value"))


@query(
    "q_set_algebra",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '2%')
       SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""",
)
def _(v: Views) -> DataFrame:
    """Intersection, difference, union."""
    a = v.orders.where(F.col("o_orderpriority").startswith("1")).select("o_custkey").distinct()
    b = v.orders.where(F.col("o_orderpriority").startswith("2")).select("o_custkey").distinct()
    n = lambda d, name: d.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only_a")).unionByName(n(a.union(b).distinct(), "either"))


@query(
    "q_rollup_shares",
    """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def _(v: Views) -> DataFrame:
    """Shares by label with pooled rows."""
    n = F.count("*")
    rows = v.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(n.alias("n"))
    total = F.max("n").over(Window.partitionBy())
    return rows.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", _r(F.col("n") / total, 6).alias("share"))


@query(
    "q_binned_counts",
    """WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
       SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' ELSE '10+' END AS bin, count(*) AS n FROM c GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    """Binned counts."""
    per = v.table("customer").join(v.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("k"))
    k = F.col("k")
    return per.groupBy(F.when(k == 0, "0").when(k == 1, "1").when(k <= 4, "2-4").when(k <= 9, "5-9").otherwise("10+").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "q_crosstab",
    """SELECT l_returnflag AS flag, count(*) FILTER (WHERE l_linestatus = 'F') AS n_f, count(*) FILTER (WHERE l_linestatus = 'O') AS n_o FROM lineitem GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    """Crosstab (D18)."""
    rows = v.table("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)
    return rows.select(F.col("l_returnflag").alias("flag"), F.col("F").alias("n_f"), F.col("O").alias("n_o"))


@query(
    "q_ip_classes",
    """WITH c AS (SELECT c_custkey, c_nationkey AS n, c_mktsegment AS m FROM customer)
       SELECT CASE WHEN c_custkey % 50 = 0 THEN 'tor' WHEN n < 3 THEN 'relay' WHEN n < 5 THEN 'tor' WHEN m = 'MACHINERY' THEN 'hosting' WHEN n >= 20 THEN 'high_risk' ELSE 'residential' END AS ip_class, count(*) AS n FROM c GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    """Address classes by precedence over dimension joins."""
    from tracewright.operators.relay import ip_class

    c = v.table("customer").withColumn("ip", F.when(F.col("c_custkey") % 50 == 0, "x.onion").otherwise("1.1.1.1"))
    nations = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"))
    flag = lambda where, name: nations.where(where).withColumn(name, F.lit(True))
    rows = c
    for where, name in (("c_nationkey < 3", "relay"), ("c_nationkey >= 3 and c_nationkey < 5", "tor"), ("c_nationkey >= 20", "risky")):
        rows = rows.join(flag(where, name), "c_nationkey", "left")
    yes = lambda k: F.coalesce(k, F.lit(False))
    kind = ip_class(F.col("ip"), yes("relay"), yes("tor"), F.col("c_mktsegment") == "MACHINERY", yes("risky"))
    return rows.groupBy(kind.alias("ip_class")).agg(F.count("*").alias("n"))


@query(
    "q_hash_split",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('T' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS part, sha256(sha256('T' || o_orderkey)) AS twice FROM orders""",
)
def _(v: Views) -> DataFrame:
    """Hashes and the split by hash."""
    h = F.sha2(F.concat(F.lit("T"), "o_orderkey"), 256)
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0
    return v.orders.select("o_orderkey", F.when(u < 0.7, "train").otherwise("test").alias("part"), F.sha2(h, 256).alias("twice"))
