"""Who sent it first: an additive model over the relay matrix, calibrated, with a decision per transaction and exact reasons.

Boosted stumps split on one feature each, so the margin is a sum of one function a feature and reasons are exact. Missing
values are filled with the training mean and flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _flagged(rows: DataFrame, features: list[str], means: dict[str, float]) -> DataFrame:
    value = {f: F.col(f).cast("double") for f in features}
    known = {f: value[f].isNotNull() & ~F.isnan(value[f]) for f in features}
    rows = rows.withColumns({f"_m_{f}": (~known[f]).cast("double") for f in features} | {f"_v_{f}": F.when(known[f], value[f]).otherwise(means[f]) for f in features})
    return VectorAssembler(inputCols=[f"{k}_{f}" for f in features for k in ("_v", "_m")], outputCol="_x").transform(rows)


@dataclass
class Origination:
    features: list[str]
    means: dict[str, float]
    model: GBTClassificationModel
    isotonic: IsotonicRegressionModel | None = None

    @classmethod
    def fit(cls, train: DataFrame, features: list[str], label: str = "label", trees: int = 40, seed: int = 7) -> Origination:
        row = train.agg(*[F.avg(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))).alias(f) for f in features]).first()
        means = {f: row[f] or 0.0 for f in features}
        gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=1, maxIter=trees, seed=seed, stepSize=0.2)
        return cls(features, means, gbt.fit(_flagged(train, features, means)))

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with p, the uncalibrated chance to be the origin."""
        out = self.model.transform(_flagged(rows, self.features, self.means))
        return out.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")

    def calibrate(self, rows: DataFrame, label: str = "label") -> Origination:
        """With an isotonic map of p to the share of origins in rows, interpolated between its steps."""
        model = IsotonicRegression(featuresCol="p", labelCol=label).fit(self.score(rows).withColumn(label, F.col(label).cast("double")))
        return Origination(self.features, self.means, self.model, model)

    def calibrated(self, rows: DataFrame) -> DataFrame:
        scored = self.score(rows)
        if self.isotonic is None:
            return scored.withColumn("q", F.col("p"))
        return self.isotonic.setPredictionCol("q").transform(scored)

    def decide(self, rows: DataFrame, least: float = 0.5) -> DataFrame:
        """capture, txid, peer_ip, q, answered: the likeliest candidate; no answer under the least chance, or where none can be given."""
        place = F.row_number().over(Window.partitionBy("capture", "txid").orderBy(F.col("q").desc(), F.col("p").desc(), "peer_ip"))
        best = self.calibrated(rows).withColumn("_place", place).where("_place = 1")
        return best.select("capture", "txid", "peer_ip", "q", ((F.col("q") >= least) & ~F.col("degenerate") & ~F.col("scope_out")).alias("answered"))

    def _steps(self) -> tuple[float, dict[str, list[tuple[str, float, float, float]]]]:
        """The trees' constant part, and of each feature (column, threshold, value up to it, value beyond)."""
        steps: dict[str, list[tuple[str, float, float, float]]] = {f: [] for f in self.features}
        constant = 0.0
        for tree, weight in zip(self.model.trees, self.model.treeWeights, strict=True):
            node = tree._call_java("rootNode")
            if node.subtreeDepth() == 0:
                constant += weight * node.prediction()
                continue
            split = node.split()
            k = split.featureIndex()
            name = self.features[k // 2]
            steps[name].append((f"_{'vm'[k % 2]}_{name}", split.threshold(), weight * node.leftChild().prediction(), weight * node.rightChild().prediction()))
        return constant, steps

    def explain(self, rows: DataFrame) -> DataFrame:
        """rows with margin and why_F of each feature: what it adds to the margin, less its mean over rows. They sum up exactly."""
        constant, steps = self._steps()
        flagged = _flagged(rows, self.features, self.means)
        terms = {f: sum((F.when(F.col(c) <= t, a).otherwise(b) for c, t, a, b in steps[f]), F.lit(0.0)) for f in self.features}
        out = flagged.withColumns({f"why_{f}": e for f, e in terms.items()})
        base = out.agg(*[F.avg(f"why_{f}").alias(f) for f in self.features]).first()
        margin = sum((F.col(f"why_{f}") for f in self.features), F.lit(constant))
        out = out.withColumn("margin", margin).withColumns({f"why_{f}": F.col(f"why_{f}") - F.lit(base[f] or 0.0) for f in self.features})
        return out.select(*rows.columns, "margin", *[f"why_{f}" for f in self.features])


def answer_frame(decided: DataFrame, txs: DataFrame) -> DataFrame:
    """Answers beside their transaction's first row (txid, ts): txid, peer_ip, q, answered, ts, captures that agree."""
    best = decided.groupBy("txid").agg(F.max_by(F.struct("peer_ip", "q", "answered"), F.struct("answered", "q", "peer_ip")).alias("d"))
    agree = decided.groupBy("txid", "peer_ip").agg(F.count("*").alias("captures"))
    rows = best.select("txid", "d.*").join(agree, ["txid", "peer_ip"], "left")
    return rows.join(txs.groupBy("txid").agg(F.min("ts").alias("ts")), "txid", "left")
