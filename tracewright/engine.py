"""The read API: one object over a session and a case's tables, whose methods return DataFrames.

Frames of a case: ``txs``, ``ins``, ``outs`` (see operators.ledger), ``members(node, component)``, ``alerts``, ``tags``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT, Config
from tracewright.functions import metrics
from tracewright.operators import ledger, paths, scoring, tags, tracing
from tracewright.operators.components import components
from tracewright.session import written


@dataclass
class Case:
    """What a case is made of; alerts and tags may be missing."""

    txs: DataFrame
    ins: DataFrame
    outs: DataFrame
    alerts: DataFrame | None = None
    tags: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, case: Case, config: Config = DEFAULT):
        self.spark, self.case, self.config = spark, case, config

    @cached_property
    def features(self) -> DataFrame:
        c = self.case
        return written(ledger.tx_features(c.txs, c.ins, c.outs, self.config), "engine-features")

    @cached_property
    def members(self) -> DataFrame:
        """node, component: wallets spent together, CoinJoins apart; components are named by their least wallet."""
        plain = self.case.ins.join(self.features.where("not coinjoin").select("txid"), "txid", "left_semi").select("txid", "addr").distinct()
        named = plain.select("addr", F.xxhash64("addr").alias("id"))
        links = plain.withColumn("b", F.xxhash64("addr")).withColumn("a", F.min("b").over(Window.partitionBy("txid"))).select("a", "b")
        found = components(links).withColumnRenamed("node", "id").join(named.distinct(), "id")
        least = found.groupBy("component").agg(F.min("addr").alias("least"))
        return written(found.join(least, "component").select(F.col("addr").alias("node"), F.col("least").alias("component")), "engine-members")

    @cached_property
    def graph(self) -> DataFrame:
        """Edges between entities: src, dst, value, n, mix_n, first_seen, last_seen."""
        c = self.case
        ins, outs = (ledger.named(x, self.members) for x in (c.ins, c.outs))
        return written(ledger.entity_edges(ins, outs, c.txs, self.features.where("coinjoin").select("txid"), who="entity"), "engine-graph")

    def summary(self) -> DataFrame:
        """One row: entities, edges, value, first and last time."""
        ends = self.graph.select(F.explode(F.array("src", "dst")).alias("e")).distinct()
        g = self.graph.agg(F.count("*").alias("edges"), F.sum("value").alias("value"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        return ends.agg(F.count("*").alias("entities")).join(g)  # one row each

    def _seed(self, *nodes: str) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in nodes], "node string")

    def neighbours(self, entity: str, k: int = 12) -> DataFrame:
        """direction, other, value, n: the largest counterparties on either side."""
        out = self.graph.where(F.col("src") == entity).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "value", "n")
        into = self.graph.where(F.col("dst") == entity).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "value", "n")
        place = F.row_number().over(Window.partitionBy("direction").orderBy(F.col("value").desc(), "other"))
        return out.unionByName(into).withColumn("place", place).where(F.col("place") <= k).drop("place")

    def subgraph(self, entity: str, hops: int = 2, most: int = 300) -> DataFrame:
        """Edges among the nearest entities within some hops either way; at most a number of them, nearest first, by name."""
        near = paths.reach(self.graph, self._seed(entity), hops, undirected=True).orderBy("hop", "node").limit(most).select("node")
        near = written(near, "engine-near")
        inside = self.graph.join(near.withColumnRenamed("node", "src"), "src", "left_semi")
        return inside.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")

    def trace(self, wallet: str, hops: int = 4, least: float = 0.0, forward: bool = True) -> DataFrame:
        return paths.wallet_trace(self.case.ins, self.case.outs, self._seed(wallet), hops, least, forward)

    def path(self, a: str, b: str, hops: int = 30) -> DataFrame:
        return paths.shortest_path(self.graph, a, b, hops)

    def taint(self, *entities: str, hops: int | None = None) -> DataFrame:
        """Taint from given entities, as if they were watched."""
        return paths.taint(self.graph, self._seed(*entities), replace(self.config, taint_hops=hops or self.config.taint_hops))

    def value(self, entity: str, hops: int | None = None, poison: bool = False) -> DataFrame:
        return paths.trace(self.graph, entity, hops or self.config.trace_hops, self.config.trace_share, poison)

    def exits(self, subject: str, hops: int | None = None, kind: str = "entity", category: str | None = None, actors: DataFrame | None = None) -> tracing.Exits:
        """Where the value of an entity, of an address' entity, or of each member of an actor leaves: tagged entities, sinks, mixes.

        category: the tags that make a service; any by default. Edges only mixes made are not crossed.
        """
        tagged = self.case.tags.where(F.col("category") == category) if category else self.case.tags
        services = ledger.named(tagged.select("address"), self.members, addr="address").select(F.col("entity").alias("node"))
        seeds = tracing.seeds_of(kind, subject, self.members, actors)
        return tracing.exit_points(self.graph, seeds, services, c=replace(self.config, trace_hops=hops or self.config.trace_hops))

    def cluster(self, component: str) -> DataFrame:
        """The wallets of a cluster with what each sent and received."""
        own = self.members.where(F.col("component") == component)
        side = lambda rows, as_: rows.groupBy(F.col("addr").alias("node")).agg(F.sum("value").alias(as_))
        return own.join(side(self.case.ins, "sent"), "node", "left").join(side(self.case.outs, "received"), "node", "left").na.fill(0.0, ["sent", "received"])

    def queue(self) -> DataFrame:
        """Alerts with their places in the total order."""
        return metrics.placed(self.case.alerts, scoring.alert_order())

    def page(self, offset: int = 0, limit: int = 50, least: float = 0.0) -> DataFrame:
        """One page of the queue, with the number of alerts in all."""
        rows = self.queue().where(F.col("risk") >= least)
        total = rows.agg(F.count("*").alias("total"))
        return rows.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).join(total).orderBy("place")  # one row

    def tagged(self) -> DataFrame:
        sure = self.members.select("component").distinct().withColumn("confidence", F.lit(1.0))
        return tags.entity_tags(tags.applied(self.case.tags, self.members, sure))

    def payload(self, edges: DataFrame) -> DataFrame:
        """kind, id, body: nodes and edges of a piece of the graph as JSON rows."""
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        size = self.members.groupBy(F.col("component").alias("id")).agg(F.count("*").alias("wallets"))
        node = ends.join(size, "id", "left").select(F.lit("node").alias("kind"), "id", F.to_json(F.struct("id", F.coalesce("wallets", F.lit(1)).alias("wallets"))).alias("body"))
        edge = edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id"), F.to_json(F.struct("src", "dst", "value", "n")).alias("body"))
        return node.unionByName(edge)

    def feedback(self, at: str, alert: str, verdict: str, analyst: str, when: str) -> None:
        """Append an analyst's verdict."""
        if verdict not in ("confirmed", "rejected", "unsure"):
            raise ValueError(f"no verdict: {verdict}")
        self.spark.createDataFrame([(alert, verdict, analyst, when)], "alert string, verdict string, analyst string, at string").write.mode("append").parquet(at)

    def fold_in(self, rows: Case) -> Engine:
        """A case with more transactions; ValueError if one is there already. Nothing of this one is changed."""
        if (again := rows.txs.join(self.case.txs.select("txid"), "txid", "left_semi").limit(3).collect()):
            raise ValueError(f"already there: {[r['txid'] for r in again]}")
        both = {k: getattr(self.case, k).unionByName(getattr(rows, k)) for k in ("txs", "ins", "outs")}
        return Engine(self.spark, replace(self.case, **both), self.config)


def write_dataset(rows: DataFrame, at: str, kind: str) -> None:
    """Append rows as csv, json or xml part files."""
    w = rows.write.mode("append")
    if kind == "xml":
        w.option("rootTag", "records").option("rowTag", "record").format("xml").save(at)
    elif kind in ("csv", "json"):
        (w.option("header", "true") if kind == "csv" else w).format(kind).save(at)
    else:
        raise ValueError(f"no writer for {kind}")


def write_payload(alerts: DataFrame, status: dict, at: str) -> None:
    """Alerts as JSON lines, and one line of what is known of the run."""
    import json

    alerts.select(F.to_json(F.struct(*alerts.columns)).alias("value")).write.mode("overwrite").text(f"{at}/alerts")
    alerts.sparkSession.createDataFrame([(json.dumps(status, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/status")
