"""Graph queries: reach, taint, traces, paths, peel chains, layering, rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT
from tracewright.operators import actors, ledger, paths, scoring, tracing
from tracewright.plans.adapters import Views, with_
from tracewright.plans.registry import query


def _seed(v: Views) -> str:
    return v.graph.agg(F.min("src")).first()[0] or "A0"


def _seeds(v: Views) -> DataFrame:
    return v.graph.agg(F.min("src").alias("node"))


@query(
    "q_reach",
    with_("graph", recursive=True, body=""" , r AS (SELECT min(src) AS node, 0 AS hop FROM graph UNION SELECT g.dst, r.hop + 1 FROM r JOIN graph g ON g.src = r.node WHERE r.hop < 3)
       SELECT node, min(hop) AS hop FROM r GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """Nodes within three hops."""
    return paths.reach(v.graph, _seeds(v), 3)


@query(
    "q_subgraph",
    with_("graph", recursive=True, body=""" , u AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph), r AS (SELECT min(src) AS node, 0 AS hop FROM graph UNION SELECT u.dst, r.hop + 1 FROM r JOIN u ON u.src = r.node WHERE r.hop < 2)
       SELECT node, min(hop) AS hop FROM r GROUP BY 1"""),
)
def _(v: Views) -> DataFrame:
    """Neighbourhood both ways within two hops (I16)."""
    return paths.reach(v.graph, _seeds(v), 2, undirected=True)


@query(
    "q_taint",
    with_("graph", recursive=True, body=""" , r AS (SELECT min(src) AS node, 0 AS hops, [min(src)] AS path FROM graph UNION ALL SELECT g.dst, r.hops + 1, list_append(r.path, g.dst) FROM r JOIN graph g ON g.src = r.node WHERE r.hops < 3 AND NOT list_contains(r.path, g.dst)),
       b AS (SELECT node, hops, path, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS k FROM r)
       SELECT node, power(0.5, hops) AS score, hops, array_to_string(path, '>') AS path FROM b WHERE k = 1"""),
)
def _(v: Views) -> DataFrame:
    """Taint with decay per hop and the least path."""
    rows = paths.taint(v.graph, _seeds(v), replace(DEFAULT, taint_hops=3))
    return rows.select("node", "score", "hops", F.array_join("path", ">").alias("path"))


def _trace_sql(hops: int, tail: str, poison: bool = False, prefix: str = "") -> str:
    """The layers of a trace from every watched account, services being stops, as common table expressions."""
    p = prefix
    goes = lambda k: f"(node = seed OR (NOT stop AND keep > 0{'' if k < hops else ' AND false'}))"
    parts = [] if p else [
        " , mflow AS (SELECT node, sum(i) AS ext_in, sum(o) AS ext_out FROM (SELECT src AS node, 0.0 AS i, value AS o FROM mixed UNION ALL SELECT dst, value, 0.0 FROM mixed) GROUP BY 1)",
        "mf AS (SELECT *, node IN (SELECT 'A' || (s_suppkey * 7) FROM supplier) AS stop, CASE WHEN ext_out > 0 THEN ext_out / greatest(ext_in, ext_out) ELSE 0.0 END AS keep FROM mflow)",
    ]
    parts.append(f"{p}l0 AS (SELECT node AS seed, node, ext_out AS amount, ext_out AS total FROM mf WHERE ext_out > 0 AND node IN (SELECT 'A' || s_suppkey FROM supplier WHERE s_acctbal < 0))")
    carried = "value" if poison else "amount * CASE WHEN node = seed THEN 1.0 ELSE keep END * value / ext_out"
    for k in range(1, hops + 1):
        spent = " AND ".join(f"(seed, node) NOT IN (SELECT (seed, node) FROM {p}l{j})" for j in range(k - 1)) or "true"
        parts.append(f"{p}m{k} AS (SELECT seed, src, dst, total, {carried} AS carried, mix_n >= n AS mix, {spent} AS fresh FROM {p}l{k - 1} JOIN mf USING (node) JOIN mixed ON src = node WHERE {goes(k - 1)} AND dst <> seed)")
        floor = "0.001" if poison else "0.001 * total"
        parts.append(f"{p}l{k} AS (SELECT seed, dst AS node, sum(carried) AS amount, total FROM {p}m{k} WHERE NOT mix{' AND fresh' if poison else ''} GROUP BY seed, dst, total HAVING sum(carried) >= {floor})")
    union = " UNION ALL ".join(f"SELECT seed, node, amount, {goes(k)} AS goes, keep, stop, {k} AS depth FROM {p}l{k} JOIN mf USING (node)" for k in range(1, hops + 1))
    parts.append(f"{p}w AS ({union})")
    parts.append(f"{p}rec AS (SELECT seed, node, sum(amount) AS received, sum(CASE WHEN goes THEN amount * (1 - keep) ELSE amount END) AS terminal FROM {p}w GROUP BY 1, 2)")
    body = ",\n".join(parts) + tail
    return body if p else with_("ins", "outs", "quant", "mixed", body=body)


_MIXES = " UNION ALL ".join(f"SELECT seed, src, dst, carried AS value, {k} AS depth FROM m{k} WHERE mix AND fresh" for k in (1, 2, 3))
_HOPS = replace(DEFAULT, trace_hops=3)


def _services(v: Views) -> DataFrame:
    return v.table("supplier").select(F.concat(F.lit("A"), F.col("s_suppkey") * 7).alias("node"))


def _accounts(v: Views) -> DataFrame:
    """The watched accounts: those of suppliers in debt."""
    return v.table("supplier").where("s_acctbal < 0").select(F.concat(F.lit("A"), "s_suppkey").alias("node"))


def _traced(v: Views, poison: bool = False) -> tracing.Traced:
    return tracing.trace(v.mixed, _accounts(v), _services(v), _HOPS, poison)


def _amounts(t: tracing.Traced) -> DataFrame:
    return t.received.select("seed", "node", F.round("received", 4).alias("received"), F.round("terminal", 4).alias("terminal"))


_AMOUNTS = " SELECT seed, node, round(received, 4) AS received, round(terminal, 4) AS terminal FROM rec"


@query("q_value_trace", _trace_sql(3, _AMOUNTS))
def _(v: Views) -> DataFrame:
    """Haircut trace from every watched account at once, up to services, across no mix."""
    return _amounts(_traced(v))


@query("q_poison_trace", _trace_sql(3, _AMOUNTS, poison=True))
def _(v: Views) -> DataFrame:
    """The same under poison, each edge counted once."""
    return _amounts(_traced(v, True))


@query("q_trace_mixes", _trace_sql(3, f" SELECT seed, src, dst, round(value, 4) AS value, depth FROM ({_MIXES})"))
def _(v: Views) -> DataFrame:
    """Where traced value met edges that only mixes made."""
    return _traced(v).mixes.select("seed", "src", "dst", F.round("value", 4).alias("value"), "depth")


@query("q_trace_limit", _trace_sql(3, " SELECT seed, round(sum(amount * keep), 2) AS amount FROM w WHERE depth = 3 AND NOT stop GROUP BY 1"))
def _(v: Views) -> DataFrame:
    """What the depth limit kept from going on."""
    return _traced(v).limit.select("seed", F.round("amount", 2).alias("amount"))


def _best_sql(p: str, share: str, hops: int = 3) -> str:
    """The confidence of each node's best path: products only fall, so the best walk is a simple path."""
    live = f"{p}e AS (SELECT r.seed, src, dst, {share} AS f FROM mixed JOIN mf ON mf.node = src JOIN {p}rec r ON r.node = dst WHERE mix_n < n AND dst <> r.seed AND (src = r.seed OR (NOT stop AND keep > 0 AND (r.seed, src) IN (SELECT (seed, node) FROM {p}rec))))"
    steps = [f"{p}b0 AS (SELECT seed, seed AS node, 1.0::DOUBLE AS c FROM l0)"]
    steps += [f"{p}b{k} AS (SELECT seed, dst AS node, max(c * f) AS c FROM {p}b{k - 1} JOIN {p}e USING (seed) WHERE src = node GROUP BY 1, 2)" for k in range(1, hops + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM {p}b{k}" for k in range(1, hops + 1))
    return ",\n".join([live, *steps, f"{p}best AS (SELECT seed, node, max(c) AS c FROM ({union}) GROUP BY 1, 2)"])


def _exits_sql(hops: int, tail: str) -> str:
    return _trace_sql(
        hops,
        ",\n" + _best_sql("", "value / ext_out", hops) + ",\n" + _trace_sql(hops, "", poison=True, prefix="p") + ",\n" + _best_sql("p", "1.0::DOUBLE", hops)
        + """, x AS (SELECT seed, node, coalesce(h.received, 0) / total AS share, coalesce(b.c, 0) AS confidence, coalesce(p.received, 0) / total AS poison_share, coalesce(pb.c, 0) AS poison_confidence, coalesce(h.terminal, 0) AS kept, coalesce(p.terminal, 0) AS poison_kept
       FROM rec h FULL JOIN prec p USING (seed, node) LEFT JOIN best b USING (seed, node) LEFT JOIN pbest pb USING (seed, node) JOIN (SELECT seed, total FROM l0) USING (seed)),
       sv AS (SELECT 'A' || (s_suppkey * 7) AS node FROM supplier)""" + tail,
    )


@query(
    "q_exit_points",
    _exits_sql(DEFAULT.trace_hops, """ SELECT seed, node, round(share, 6) AS share, round(confidence, 6) AS confidence, round(share * confidence, 6) AS score, round(poison_share, 6) AS poison_share, round(poison_share * poison_confidence, 6) AS poison_score, rank
       FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY share * confidence DESC, poison_share * poison_confidence DESC, node) AS rank FROM x SEMI JOIN sv USING (node)) WHERE rank <= 10"""),
)
def _(v: Views) -> DataFrame:
    """The ten best services of every seed within the engine's eight hops, by share times path confidence under both models."""
    rows = tracing.exit_points(v.mixed, _accounts(v), _services(v)).candidates
    return rows.select("seed", "node", *[F.round(c, 6).alias(c) for c in ("share", "confidence", "score", "poison_share", "poison_score")], "rank")


@query("q_exit_sinks", _exits_sql(3, """ SELECT seed, node, round(kept, 4) AS kept, round(poison_kept, 4) AS poison_kept, round(kept / total, 6) AS share_kept FROM x ANTI JOIN sv USING (node) JOIN (SELECT seed, total FROM l0) USING (seed) WHERE kept / total >= 0.05"""))
def _(v: Views) -> DataFrame:
    """Nodes that are no service and keep a twentieth of a seed's outflow or more."""
    rows = tracing.exit_sinks(v.mixed, _accounts(v), _services(v), _HOPS)
    return rows.select("seed", "node", F.round("kept", 4).alias("kept"), F.round("poison_kept", 4).alias("poison_kept"), F.round("share_kept", 6).alias("share_kept"))


@query(
    "q_trace_paths",
    with_("graph", recursive=True, body=""" , t AS (SELECT src, sum(value) AS s FROM graph GROUP BY 1), r AS (SELECT min(src) AS node, [min(src)] AS path, 1.0::DOUBLE AS c FROM graph
       UNION ALL SELECT dst, list_append(path, dst), c * value / s FROM r JOIN graph ON src = node JOIN t USING (src) WHERE len(path) <= 3 AND NOT list_contains(path, dst)),
       k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, len(path), path) AS rank FROM r WHERE len(path) > 1)
       SELECT node, round(c, 8) AS confidence, rank FROM k WHERE rank <= 3"""),
)
def _(v: Views) -> DataFrame:
    """The confidences of the three best simple paths to each node."""
    return paths.trace_paths(v.graph, _seed(v), 3).select("node", F.round("confidence", 8).alias("confidence"), "rank")


@query("q_weighted_taint")
def _(v: Views) -> DataFrame:
    """Taint from the suppliers' accounts, each of its own weight, across no mix."""
    seeds = v.table("supplier").select(F.concat(F.lit("A"), "s_suppkey").alias("node"), (F.lit(0.25) + F.col("s_suppkey") % 4 * 0.25).alias("weight"))
    rows = tracing.weighted_taint(v.mixed, seeds, replace(DEFAULT, taint_hops=3))
    return rows.select("node", "score", "hops", F.array_join("path", ">").alias("path"))


@query(
    "q_shortest_path",
    with_("graph", recursive=True, body=""" , z AS (SELECT min(src) AS a, max(dst) AS b FROM graph), r AS (SELECT a AS node, 0 AS hop FROM z UNION SELECT g.dst, r.hop + 1 FROM r JOIN graph g ON g.src = r.node WHERE r.hop < 8),
       d AS (SELECT node, min(hop) AS hop FROM r GROUP BY 1), p AS (SELECT d2.node, min(d1.node) AS parent, any_value(d2.hop) AS hop FROM d d1 JOIN graph g ON g.src = d1.node JOIN d d2 ON d2.node = g.dst AND d2.hop = d1.hop + 1 GROUP BY 1),
       w AS (SELECT p.hop AS step, p.node, p.parent FROM p, z WHERE p.node = z.b UNION ALL SELECT w.step - 1, p.node, p.parent FROM w JOIN p ON p.node = w.parent)
       SELECT step, node FROM w UNION ALL SELECT 0, a FROM z WHERE EXISTS (SELECT 1 FROM w)"""),
)
def _(v: Views) -> DataFrame:
    """A shortest directed path between the least sender and the largest receiver."""
    ends = v.graph.agg(F.min("src"), F.max("dst")).first()
    return paths.shortest_path(v.graph, ends[0] or "", ends[1] or "", 8)


@query(
    "q_neighbours",
    with_("graph", body=""" SELECT src, dst, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst) AS r FROM graph) WHERE r <= 12"""),
)
def _(v: Views) -> DataFrame:
    """The twelve largest counterparties."""
    w = Window.partitionBy("src").orderBy(F.col("value").desc(), "dst")
    return v.graph.repartition(v.parts, "src").withColumn("r", F.row_number().over(w)).where("r <= 12").select("src", "dst", F.round("value", 4).alias("value"))


def _peels(v: Views) -> DataFrame:
    f = ledger.tx_features(v.txs, v.ins, v.outs)
    return paths.peel_links(f, v.outs, ledger.first_spender(v.ins, v.txs), 0.8)


_PEEL = """ , two AS (SELECT txid, arg_max(addr, (value, -idx)) AS addr FROM outs GROUP BY 1 HAVING count(*) = 2 AND min(value) / max(value) <= 0.8), sp AS (SELECT addr, arg_min(txid, (ts, txid)) AS nx FROM ins JOIN tx USING (txid) GROUP BY 1),
       n AS (SELECT two.txid, nx FROM two JOIN sp USING (addr) WHERE nx IN (SELECT txid FROM two) AND nx <> two.txid), r AS (SELECT txid AS head, nx AS at_ FROM n WHERE txid NOT IN (SELECT nx FROM n) UNION SELECT r.head, n.nx FROM r JOIN n ON n.txid = r.at_)"""


@query("q_peel_links", with_("tx", "ins", "outs", body=_PEEL.split(" , r AS")[0].rsplit(", r AS", 1)[0] + " SELECT txid, nx AS next FROM n"))
def _(v: Views) -> DataFrame:
    """The successor table of peel-shaped transactions."""
    return _peels(v)


@query("q_peel_chains", with_("tx", "ins", "outs", recursive=True, body=_PEEL + " SELECT head, count(DISTINCT at_) AS hops FROM r GROUP BY 1"))
def _(v: Views) -> DataFrame:
    """Chain heads and lengths by pointer doubling."""
    return paths.peel_chains(_peels(v), 1)


@query(
    "q_layering",
    with_("tx", "ins", "outs", recursive=True, body=""" , o AS (SELECT txid, count(*) AS n FROM outs GROUP BY 1), sp AS (SELECT addr, arg_min(txid, (ts, txid)) AS nx FROM ins JOIN tx USING (txid) GROUP BY 1),
       fl AS (SELECT DISTINCT outs.txid, nx, tx.ts AS nts FROM outs JOIN sp USING (addr) JOIN tx ON tx.txid = nx WHERE nx <> outs.txid),
       r AS (SELECT o.txid AS split, ts AS t0, o.txid, 0 AS hop FROM o JOIN tx USING (txid) WHERE n >= 7 UNION SELECT r.split, r.t0, fl.nx, r.hop + 1 FROM r JOIN fl ON fl.txid = r.txid WHERE fl.nts - r.t0 <= 864000 AND r.hop < 2),
       m AS (SELECT split, txid, min(hop) AS hop FROM r GROUP BY 1, 2)
       SELECT split, m.txid AS merge, hop AS hops FROM m JOIN (SELECT DISTINCT txid FROM ins) USING (txid) WHERE hop > 0
         AND EXISTS (SELECT 1 FROM m x JOIN outs ON outs.txid = x.txid JOIN ins ON ins.addr = outs.addr AND ins.txid = m.txid WHERE x.split = m.split)"""),
)
def _(v: Views) -> DataFrame:
    """Splits that meet a merge in time."""
    c = replace(DEFAULT, layering_outs=7, layering_ins=1, layering_hours=240.0, layering_hops=2)
    f = ledger.tx_features(v.txs, v.ins, v.outs).withColumn("coinjoin", F.lit(False))
    return paths.layering(v.txs, f, v.ins, v.outs, ledger.first_spender(v.ins, v.txs), c).select("split", "merge", "hops")


_WALK = _PEEL.split(", r AS")[0] + """, rr AS (SELECT txid AS h, nx AS at_ FROM n UNION SELECT rr.h, n.nx FROM rr JOIN n ON n.txid = rr.at_), wl AS (SELECT h AS txid, count(*) AS hops FROM rr WHERE h NOT IN (SELECT h FROM rr WHERE h = at_) GROUP BY 1)"""


@query(
    "q_rule_alerts",
    with_("tx", "ins", "outs", "quant", recursive=True, body=_PEEL + """ , c AS (SELECT a.txid, a.idx, (SELECT count(*) FROM quant b WHERE b.txid = a.txid AND abs(b.value - a.value) <= 0.02 * greatest(a.value, 1e-12)) AS n FROM quant a), g AS (SELECT txid, max(n) AS n, count(*) AS outs FROM c GROUP BY 1),
       al AS (SELECT txid AS entity, 'coinjoin' AS rule, 0.35 + 0.65 * least(1.0, (n - 3) / 7.0) AS score, n || ' of ' || outs || ' outputs carry equal value' AS reason FROM g WHERE n >= 3
       UNION ALL SELECT head, 'peel_chain', CASE WHEN hops < 1 THEN 0.0 ELSE 0.35 + 0.65 * least(1.0, (hops - 1) / 11.0) END, 'a chain of ' || hops || ' peels starts here' FROM (SELECT head, count(DISTINCT at_) AS hops FROM r GROUP BY 1))
       SELECT entity, rule, round(score, 6)::DOUBLE AS score, reason FROM al WHERE score >= 0.35"""),
)
def _(v: Views) -> DataFrame:
    """Two detectors, ramps, reasons and the floor."""
    c = replace(DEFAULT, rule_keep=0.35, peel_hops=1)
    mixes = scoring.rule_coinjoin(ledger.tx_features(v.txs, v.ins, v.quantities), c)
    rows = scoring.run_rules(mixes, scoring.rule_peel_chain(paths.peel_chains(_peels(v), 1), c), c=c)
    return rows.select("entity", "rule", F.round("score", 6).alias("score"), "reason")


@query(
    "q_ransomware",
    with_("tx", "ins", "outs", recursive=True, body=_WALK + """ , i AS (SELECT txid, addr, row_number() OVER (PARTITION BY addr ORDER BY ts, txid) = 1 AS f FROM ins JOIN tx USING (txid)), p AS (SELECT o.addr AS entity, i.addr AS sender, max(CAST(f AS INT)) AS f FROM outs o JOIN i USING (txid) WHERE o.addr <> i.addr GROUP BY 1, 2),
       q AS (SELECT entity, count(*) AS senders, avg(f) AS new_share FROM p GROUP BY 1), w AS (SELECT addr AS entity, hops FROM sp JOIN wl ON wl.txid = sp.nx)
       SELECT entity, senders, round(new_share, 6) AS new_share, hops, senders || ' senders, walk of ' || hops || ' peels' AS reason FROM q JOIN w USING (entity) WHERE senders >= 5 AND new_share >= 0.05 AND hops >= 1"""),
)
def _(v: Views) -> DataFrame:
    """Collectors paid by many senders, some for the first time, with a peel walk leading away."""
    c = replace(DEFAULT, ransom_new=0.05, ransom_walk=1)
    walks = ledger.first_spender(v.ins, v.txs).select("addr", "txid").join(paths.walk_lengths(_peels(v)), "txid").select("addr", "hops")
    hits = scoring.rule_ransomware(v.ins, v.outs, v.txs, walks, c)
    i = v.ins.join(v.txs.select("txid", "ts"), "txid")
    i = i.withColumn("f", (F.row_number().over(Window.partitionBy("addr").orderBy("ts", "txid")) == 1).cast("int"))
    per = v.outs.select("txid", F.col("addr").alias("entity")).join(i.select("txid", F.col("addr").alias("sender"), "f"), "txid").where("sender <> entity").groupBy("entity", "sender").agg(F.max("f").alias("f"))
    per = per.groupBy("entity").agg(F.count("*").alias("senders"), F.round(F.avg("f"), 6).alias("new_share"))
    return per.join(hits.select("entity", "reason"), "entity").join(walks.withColumnRenamed("addr", "entity"), "entity").select("entity", "senders", "new_share", "hops", "reason")


@query(
    "q_message_passing",
    with_("graph", body=""" , x AS (SELECT src AS node, [CAST(count(*) AS DOUBLE), -5.0] AS x FROM graph GROUP BY 1)
       SELECT dst, CAST(k AS INT) AS k, round(sum(greatest(x[k + 1] + [1.0, CAST(n AS DOUBLE)][k + 1], 0.0)), 6) AS m FROM graph JOIN x ON x.node = src, (VALUES (0), (1)) AS s(k) GROUP BY 1, 2"""),
)
def _(v: Views) -> DataFrame:
    """One round of message passing along edges."""
    nodes = v.graph.groupBy(F.col("src").alias("node")).agg(F.array(F.count("*").cast("double"), F.lit(-5.0)).alias("x"))
    edges = v.graph.select("src", "dst", F.array(F.lit(1.0), F.col("n").cast("double")).alias("e"))
    return paths.messages(nodes, edges.repartition(v.parts, "src")).select("dst", "k", F.round("m", 6).alias("m"))


_ACTORS = """ w AS (SELECT 'A' || o_custkey AS entity, max(o_totalprice) / 600000.0 AS rules, (o_custkey % 10) / 10.0 AS taint, (o_custkey % 7) / 9.0 AS anomaly FROM orders GROUP BY o_custkey),
       sg AS (SELECT *, 1 / (1 + exp(-(2.0 * rules + 1.5 * taint + 0.5 * anomaly - 2.0))) AS risk FROM w),
       al AS (SELECT 'A' || o_custkey AS entity, 'P' || CAST(o_orderdate AS DATE) || o_orderpriority AS peer, o_totalprice / 1000000.0 AS confidence, epoch(o_orderdate)::BIGINT // 86400 % 3 = 0 AS fit, o_orderpriority IN ('1-URGENT', '2-HIGH') AS based FROM orders WHERE o_orderstatus <> 'P'),
       ed AS (SELECT peer AS a, entity AS b, max(confidence) AS c FROM al WHERE fit AND based GROUP BY 1, 2), both_ AS (SELECT a AS x, b AS y, c FROM ed UNION ALL SELECT b, a, c FROM ed),
       cc AS (SELECT entity AS root, entity AS x FROM sg UNION SELECT root, y FROM cc JOIN both_ USING (x)),
       mb AS (SELECT sg.*, root FROM (SELECT x AS entity, min(root) AS root FROM cc GROUP BY 1) JOIN sg USING (entity)),
       an AS (SELECT root, arg_max(entity, (risk, entity)) AS anchor FROM mb GROUP BY 1),
       wd AS (SELECT anchor AS x, 1.0::DOUBLE AS width FROM an UNION SELECT y, least(width, c) FROM wd JOIN both_ USING (x)),
       mw AS (SELECT mb.*, width FROM mb JOIN (SELECT x AS entity, max(width) AS width FROM wd GROUP BY 1) USING (entity)),
       ag AS (SELECT root, count(*) AS members, max(rules * width) AS rules, max(taint * width) AS taint, max(anomaly * width) AS anomaly FROM mw GROUP BY 1),
       lk AS (SELECT root, count(DISTINCT peer) AS peers, min(confidence) AS membership FROM al JOIN mb USING (entity) GROUP BY 1)"""


@query(
    "q_actors",
    "WITH RECURSIVE" + _ACTORS + """ SELECT 'A-' || row_number() OVER (ORDER BY root) AS actor, anchor, members, coalesce(peers, 0) AS peers, round(1 / (1 + exp(-(2.0 * rules + 1.5 * taint + 0.5 * anomaly - 2.0))), 6) AS risk, round(coalesce(membership, 1.0), 8) AS membership
       FROM ag JOIN an USING (root) LEFT JOIN lk USING (root)""",
)
def _(v: Views) -> DataFrame:
    """Actors of all customers, joined through the peers of their orders."""
    o, entity = v.orders, F.concat(F.lit("A"), "o_custkey")
    signals = o.groupBy(entity.alias("entity"), "o_custkey").agg((F.max("o_totalprice") / 600000.0).alias("rules"))
    signals = signals.select("entity", "rules", (F.col("o_custkey") % 10 / 10.0).alias("taint"), (F.col("o_custkey") % 7 / 9.0).alias("anomaly"))
    day = F.col("o_orderdate").cast("timestamp")
    links = o.select(
        F.concat(F.lit("P"), day.cast("date").cast("string"), "o_orderpriority").alias("peer"), entity.alias("entity"), (F.col("o_totalprice") / 1000000.0).alias("confidence"), F.lit("IP").alias("peer_kind"),
        F.when(F.floor(F.unix_seconds(day) / 86400) % 3 == 0, "residential").otherwise("hosting").alias("ip_class"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "both").otherwise("correlation").alias("basis"), (F.col("o_orderstatus") == "P").alias("mixed"),
    )
    rows = actors.actors(signals, links, {"rules": 2.0, "taint": 1.5, "anomaly": 0.5}, -2.0)
    return rows.select("actor", "anchor", "members", "peers", F.round("risk", 6).alias("risk"), F.round("membership", 8).alias("membership"))
