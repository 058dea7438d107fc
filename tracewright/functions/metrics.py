"""Evaluation metrics as exact aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import written


def before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with running totals of what stands strictly before a row in a total order, named as the arguments.

    Rows are dealt out by ranges of the order and written; a range's totals are one row, and a window runs within a range.
    """
    at = written(rows.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = at.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}_all") for k in sums])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{k}_all").over(earlier), F.lit(0)).alias(f"_{k}_before") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = at.join(F.broadcast(totals), "_range")
    return out.select(*rows.columns, *[(F.col(f"_{k}_before") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).alias(k) for k in sums])


def placed(rows: DataFrame, order: list[Column], as_: str = "place") -> DataFrame:
    """rows with their place, from 1, in a total order."""
    return before(rows, order, **{as_: F.lit(1).cast("long")}).withColumn(as_, F.col(as_) + 1)


def quantiles(rows: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """Exact interpolated quantiles: values are counted, and the ranks looked up among the counts."""
    held = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = before(held, [F.col("v").asc()], start=F.col("n"))
    total = held.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(at)
    ranks = [q * (total - 1) for q in at]
    value_at = lambda r: F.max(F.when((F.col("start") <= r) & (F.col("start") + F.col("n") > r), F.col("v")))
    got = ranked.agg(*[value_at(F.lit(int(r) + up if int(r) + up < total else int(r))).alias(f"q{k}_{up}") for k, r in enumerate(ranks) for up in (0, 1)]).first()
    return [float(got[f"q{k}_0"] + (got[f"q{k}_1"] - got[f"q{k}_0"]) * (r - int(r))) for k, r in enumerate(ranks)]


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by average ranks. Equal scores are one row before the running sum, which goes range by range."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    by = before(by, [F.col("s").asc()], below=F.col("n") - F.col("p"))
    by = by.withColumn("wins", F.col("p") * (F.col("below") + 0.5 * (F.col("n") - F.col("p"))))
    t = by.agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def reliability(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate: predictions against outcomes in equal bins."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def calibration(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """n, brier, ece."""
    b = reliability(rows, p, label, bins)
    ece = b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    brier = rows.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))
    return brier.join(ece)  # one row each


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labelings, from their contingency table."""
    pairs = lambda c: c * (c - 1) / 2.0
    n = F.col("n").cast("double")
    table = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = table.agg(F.sum(pairs(n)).alias("ab"), F.sum(n).alias("n"))
    left = table.groupBy(a).agg(F.sum(n).alias("n")).agg(F.sum(pairs(n)).alias("a"))
    right = table.groupBy(b).agg(F.sum(n).alias("n")).agg(F.sum(pairs(n)).alias("b"))
    x = both.join(left).join(right)  # one row each
    expected = F.col("a") * F.col("b") / pairs(F.col("n"))
    top = (F.col("a") + F.col("b")) / 2.0
    return x.select(F.when(top != expected, (F.col("ab") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = hits / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (mid - half) / (1 + z * z / n)), F.least(F.lit(1.0), (mid + half) / (1 + z * z / n))


def cutoff_grid(rows: DataFrame, p: str, label: str, wrong: float = 2.0) -> DataFrame:
    """cutoff, answered, cost of abstaining under each cutoff of 0.10 .. 0.90 by 0.05; one explode, one aggregation."""
    grid = F.explode(F.transform(F.sequence(F.lit(2), F.lit(18)), lambda k: k / 20.0)).alias("cutoff")
    x = rows.select(p, label, grid)
    told = F.col(p) >= F.col("cutoff")
    gain = F.when(~told, 0.0).when(F.col(label) == 1, 1.0).otherwise(-wrong)
    return x.groupBy("cutoff").agg(F.sum(told.cast("long")).alias("answered"), F.avg(gain).alias("value"))


def confusion(rows: DataFrame, said: str, truth: str) -> DataFrame:
    return rows.groupBy(said).pivot(truth, [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
