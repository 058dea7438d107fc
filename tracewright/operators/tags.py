"""Tags on entities and addresses: what applies to whom, with what confidence, and the risk it adds.

Frames: ``tags`` as in sources.intel.TAG, with a column bundle; ``members(node, component)``; ``sure(component, confidence)``
is a cluster's merge confidence, 1 where it is not given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.sources.intel import RISK

#: Parts that an entity's wallets are dealt out to; result rows a task, and tasks at most.
PARTS, TASK_ROWS, MOST_TASKS = 64, 5_000_000, 2000


def seed_entities(watch: DataFrame, members: DataFrame) -> DataFrame:
    """entity, weight: the largest weight of a watched address (addr, weight) of each entity."""
    m = members.select(F.col("node").alias("addr"), "component")
    return watch.join(m, "addr", "left").groupBy(F.coalesce("component", "addr").alias("entity")).agg(F.max("weight").alias("weight"))


def applied(tags: DataFrame, members: DataFrame, sure: DataFrame) -> DataFrame:
    """entity, address, label, category, bundle, applies, effective: a tag on each entity that holds its address.

    A cluster tag counts for the whole entity, less its merge confidence; an address tag only where the address stands alone.
    """
    m = members.select(F.col("node").alias("address"), F.col("component").alias("entity"))
    size = members.groupBy(F.col("component").alias("entity")).agg(F.count("*").alias("size"))
    rows = tags.join(m, "address", "left").withColumn("entity", F.coalesce("entity", "address")).join(size, "entity", "left")
    rows = rows.join(sure.select(F.col("component").alias("entity"), F.col("confidence").alias("merge")), "entity", "left")
    many = F.coalesce("size", F.lit(1)) > 1
    wide = F.col("applies_to") == "cluster"
    effective = F.col("confidence") * F.when(wide & many, F.coalesce("merge", F.lit(1.0))).otherwise(1.0)
    return rows.select("entity", "address", "label", "category", "bundle", (wide | ~many).alias("applies"), F.round(effective, 4).alias("effective"))


def entity_tags(rows: DataFrame, risk: dict[str, float] = RISK) -> DataFrame:
    """entity, tags, member_tags, categories, conflict, score: the strongest risk-weighted tag that applies."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in risk.items() for x in kv]), F.col("category")), F.lit(0.0))
    own = F.when(F.col("applies"), weight * F.col("effective"))
    got = rows.groupBy("entity").agg(
        F.sum(F.col("applies").cast("long")).alias("tags"), F.sum((~F.col("applies")).cast("long")).alias("member_tags"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.size(F.collect_set("category")).alias("n_categories"), F.size(F.collect_set(F.when(F.col("applies"), F.col("label")))).alias("n_labels"), F.coalesce(F.max(own), F.lit(0.0)).alias("score"),
    )
    return got.select("entity", "tags", "member_tags", "categories", ((F.col("n_categories") > 1) | (F.col("n_labels") > 1)).alias("conflict"), "score")


def address_tags(tags: DataFrame, members: DataFrame, sure: DataFrame) -> DataFrame:
    """address, label, category, via, effective: an address's own tags, and the cluster tags of its entity's other members."""
    own = tags.select("address", "label", "category", F.col("address").alias("via"), F.col("confidence").alias("effective"))
    m = members.select(F.col("node").alias("address"), F.col("component").alias("entity"))
    wide = applied(tags.where("applies_to = 'cluster'"), members, sure).select("entity", F.col("address").alias("via"), "label", "category", "effective")
    # An entity gives a row for each of its tags and wallets: its wallets are dealt out by what they give, so no entity is one task.
    per = wide.groupBy("entity").agg(F.count("*").alias("n")).join(m.groupBy("entity").agg(F.count("*").alias("held")), "entity")
    rows = per.agg(F.sum(F.col("n").cast("double") * F.col("held"))).first()[0] or 0.0
    tasks = min(MOST_TASKS, int(rows // TASK_ROWS) + int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    m = m.withColumn("part", F.pmod(F.xxhash64("address"), F.lit(PARTS))).repartition(tasks, "entity", "part")
    wide = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))).repartition(tasks, "entity", "part")
    return own.unionByName(wide.join(m, ["entity", "part"]).where("via <> address").select("address", "label", "category", "via", "effective"))
