"""Rules, links, fusion and ranking: detectors, lead scores, signals, stacker, alerts, actors, fingerprints, anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT, Config
from tracewright.functions.metrics import quantiles
from tracewright.session import written


#: Rows a task groups by key.
TASK_ROWS = 2_000_000


def ramp(value: Column, floor: float, target: float, base: float) -> Column:
    """0 below the floor, then from base up to 1 at the target."""
    return F.when(value < floor, 0.0).otherwise(base + (1 - base) * F.least(F.lit(1.0), (value - floor) / (target - floor)))


def rule_coinjoin(features: DataFrame, c: Config = DEFAULT) -> DataFrame:
    score = ramp(F.col("equal_outputs").cast("double"), 3, 10, c.rule_base)
    hit = (F.col("equal_outputs") >= c.coinjoin_group) & (F.col("n_out") >= c.coinjoin_outputs)
    reason = F.format_string("%d of %d outputs carry equal value", "equal_outputs", "n_out")
    return features.where(hit).select(F.col("txid").alias("entity"), F.lit("coinjoin").alias("rule"), score.alias("score"), reason.alias("reason"))


def rule_peel_chain(chains: DataFrame, c: Config = DEFAULT) -> DataFrame:
    score = ramp(F.col("hops").cast("double"), c.peel_hops, 12, c.rule_base)
    return chains.select(F.col("head").alias("entity"), F.lit("peel_chain").alias("rule"), score.alias("score"), F.format_string("a chain of %d peels starts here", "hops").alias("reason"))


def rule_layering(found: DataFrame, c: Config = DEFAULT) -> DataFrame:
    reason = F.format_string("split meets merge %s after %d hops", "merge", "hops")
    return found.select(F.col("split").alias("entity"), F.lit("layering").alias("rule"), ramp(F.col("traced"), c.layering_traced, 1.0, c.rule_base).alias("score"), reason.alias("reason"))


def rule_ransomware(ins: DataFrame, outs: DataFrame, txs: DataFrame, walks: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Collectors: many senders, mostly first-time spenders, and a peel walk leading away. walks: addr, hops."""
    i = ins.select("txid", "addr").distinct().join(txs.select("txid", "ts"), "txid")
    first = F.row_number().over(Window.partitionBy("addr").orderBy("ts", "txid")) == 1
    i = i.withColumn("first_time", first.cast("double"))
    paid = outs.select("txid", F.col("addr").alias("entity")).distinct().join(i.withColumnRenamed("addr", "sender"), "txid").where("sender <> entity")
    per = paid.groupBy("entity", "sender").agg(F.max("first_time").alias("first_time"))
    per = per.groupBy("entity").agg(F.count("*").alias("senders"), F.avg("first_time").alias("new_share"))
    rows = per.join(walks.withColumnRenamed("addr", "entity"), "entity").where((F.col("senders") >= c.ransom_senders) & (F.col("new_share") >= c.ransom_new) & (F.col("hops") >= c.ransom_walk))
    half = 0.5 * ramp(F.col("senders").cast("double"), c.ransom_senders, 25, 0.0) + 0.5 * ramp(F.col("hops").cast("double"), c.ransom_walk, 8, 0.0)
    reason = F.format_string("%d senders, walk of %d peels", "senders", "hops")
    return rows.select("entity", F.lit("ransomware_collector").alias("rule"), (c.rule_base + (1 - c.rule_base) * half).alias("score"), reason.alias("reason"))


def run_rules(*found: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """All detectors' alerts at or over the floor."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.where(F.col("score") >= c.rule_keep)


def links(seen: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Leads (entity, ip) from observations (entity, ip, txid, confidence, masked): effective count, penalties, score."""
    one = seen.groupBy("entity", "ip", "txid").agg(F.max("confidence").alias("confidence"), F.max("masked").alias("masked"))
    rows = one.groupBy("entity", "ip").agg(F.count("*").alias("txs"), F.sum("confidence").alias("effective"), F.max("masked").alias("masked"))
    shared = rows.groupBy("ip").agg(F.count("*").alias("entities"))
    rows = rows.join(shared, "ip")
    raw = 1 - F.exp(-F.col("effective") / 2.0)
    asn = F.when(F.col("masked"), c.asn_penalty).otherwise(1.0)
    many = F.when(F.col("entities") <= c.shared_from, 1.0).otherwise(F.greatest(F.lit(c.shared_floor), F.lit(float(c.shared_from)) / F.col("entities")))
    return rows.select("entity", "ip", "txs", "effective", "entities", asn.alias("asn_penalty"), many.alias("shared_penalty"), (raw * asn * many).alias("score"))


def top_leads(leads: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.col("score").desc(), "ip")
    return leads.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def signals(entities: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """entities (column entity) with the largest score of each part (entity, score); 0 where there is none."""
    rows = entities
    for name, part in parts.items():
        rows = rows.join(part.groupBy("entity").agg(F.max("score").alias(name)), "entity", "left")
    return rows.na.fill(0.0, list(parts))


def weighted(rows: DataFrame, weights: dict[str, float], as_: str = "risk") -> DataFrame:
    total = sum(weights.values())
    return rows.withColumn(as_, sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / total)


def stacker(rows: DataFrame, features: list[str], label: str = "label"):
    """A class-balanced logistic model with weights >= 0, fitted by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    n = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    weight = F.when(F.col(label) == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9))
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.withColumn("_w", weight))
    low = Matrices.dense(1, len(features), [0.0] * len(features))
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1e-4, maxIter=50, standardization=False, lowerBoundsOnCoefficients=low).fit(data)
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept)


def stacked(rows: DataFrame, weights: dict[str, float], intercept: float, as_: str = "risk") -> DataFrame:
    return rows.withColumn(as_, 1 / (1 + F.exp(-(sum((F.col(k) * w for k, w in weights.items()), F.lit(intercept))))))


def contributions(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Exact additive contributions: weight times distance to the mean, per feature."""
    means = rows.agg(*[F.avg(k).alias(k) for k in weights]).first()
    return rows.select("*", *[(w * (F.col(k) - F.lit(means[k]))).alias(f"why_{k}") for k, w in weights.items()])


def alert_order() -> list[Column]:
    """Risk, rule kinds, taint hops (none last), lead confidence, transactions, then the id: a total order."""
    return [F.col("risk").desc(), F.col("rule_kinds").desc(), F.coalesce("taint_hops", F.lit(1_000_000)).asc(), F.col("lead_confidence").desc(), F.col("tx_count").desc(), F.col("entity").asc()]


def peer_groups(rows: DataFrame, dims: list[str], c: Config = DEFAULT) -> DataFrame:
    """group: per dimension how many distinct quantile edges a value exceeds; small groups are pooled as 'all'."""
    edges = {d: sorted(set(quantiles(rows, d, list(c.peer_quantiles))) - {None}) for d in dims}
    parts = [F.concat(F.lit(d[:3]), sum((F.when(F.col(d) > e, 1).otherwise(0) for e in edges[d]), F.lit(0)).cast("string")) for d in dims]
    named = rows.withColumn("group", F.concat_ws("|", *parts))
    n = named.groupBy("group").agg(F.count("*").alias("_n"))
    return named.join(F.broadcast(n), "group").withColumn("group", F.when(F.col("_n") >= c.peer_group_least, F.col("group")).otherwise("all")).drop("_n")


def _forest(x: np.ndarray, trees: int, sample: int, seed: int):
    """Isolation trees as nested tuples, grown on subsamples."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int):
        if depth == 0 or len(rows) <= 1 or (rows.max(0) == rows.min(0)).all():
            return len(rows)
        wide = np.flatnonzero(rows.max(0) > rows.min(0))
        f = int(rng.choice(wide))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] <= cut
        return f, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    size = min(sample, len(x))
    return [grow(x[rng.choice(len(x), size, replace=False)], int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _flat(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays: feature (of leaves 0), cut, the left child (the right one follows it; a leaf leads to itself), path length."""
    rows, at, todo = [[0, np.inf, 0, 0.0]], 0, [(tree, 0)]
    while at < len(todo):
        node, depth = todo[at]
        if isinstance(node, tuple):
            f, cut, a, b = node
            rows[at] = [f, cut, len(todo), 0.0]
            todo += [(a, depth + 1), (b, depth + 1)]
            rows += [[0, np.inf, 0, 0.0], [0, np.inf, 0, 0.0]]
        else:
            rows[at] = [0, np.inf, at, depth + _path(node)]
        at += 1
    f, cut, left, path = zip(*rows, strict=True)
    return np.array(f, np.int64), np.array(cut, float), np.array(left, np.int64), np.array(path, float)


def _depths(forest: list[tuple], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over flat trees: all rows go down a tree together, a step a level."""
    flat = np.ascontiguousarray(x).ravel()
    start = np.arange(len(x)) * x.shape[1]
    total = np.zeros(len(x))
    for f, cut, left, path in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            down = left[at] + ~(flat[start + f[at]] <= cut[at])
            if (down == at).all():
                break
            at = down
        total += path[at]
    return total / len(forest)


def isolation_forest(rows: DataFrame, features: list[str], key: str = "entity", trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """key, group, score in [0, 1]: isolation scores within peer groups, scaled by the group's least and largest.

    A group's trees grow on a bounded sample (8 x sample rows by a hash of the key); every row is then scored in a map, so
    a group is never gathered. Rows are made once, and scored once for the groups' ends and the scores.
    """
    rows = written(rows.select(key, "group", *features), "forest-rows")
    held = rows.groupBy("group").agg(F.count("*").alias("_held"))
    cap = sample * 8
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.join(F.broadcast(held), "group").where(u * F.col("_held") < cap).select("group", key, *features)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        import pickle

        part = part.sort_values(key)
        x = part[features].fillna(0.0).to_numpy(float)
        return pd.DataFrame({"group": [part["group"].iloc[0]], "forest": [pickle.dumps([_flat(t) for t in _forest(x, trees, sample, seed)])], "size": [min(sample, len(x))]})

    forests = picked.groupBy("group").applyInPandas(fit, "group string, forest binary, size int")
    by = {r["group"]: (bytes(r["forest"]), r["size"]) for r in forests.collect()}  # one row a group: at most 4^dims
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def score(frames):
        import pickle

        known = {g: (pickle.loads(f), n) for g, (f, n) in shared.value.items()}
        for frame in frames:
            got = np.zeros(len(frame))
            for g, idx in frame.groupby("group").indices.items():
                forest, n = known.get(g, ([], 0))
                if n >= 2:
                    x = frame.iloc[idx][features].fillna(0.0).to_numpy(float)
                    got[idx] = 2.0 ** (-_depths(forest, x) / max(_path(n), 1e-9))
            yield pd.DataFrame({key: frame[key], "group": frame["group"], "raw": got})

    kind = dict(rows.dtypes)[key]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work
    raw = written(rows.repartition(parts, key).mapInPandas(score, f"{key} {kind}, group string, raw double"), "forest-scores")
    ends = raw.groupBy("group").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return raw.join(F.broadcast(ends), "group").select(key, "group", scaled.alias("score"))


def naive_bayes(rows: DataFrame, tells: list[str], label: str = "label", key: str = "txid") -> DataFrame:
    """key, guess, log_p, novelty: categorical naive Bayes with Laplace smoothing, fitted on rows and applied to them.

    The model is two count tables: (label) and (label, tell, value). novelty is the largest surprise of a tell overall.
    """
    long = rows.select(key, F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(t).alias("tell"), F.col(t).cast("string").alias("value")) for t in tells])).alias("x"))
    long = long.select(key, "label", "x.tell", "x.value").where("value is not null")
    n_label = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    held = long.groupBy("label", "tell", "value").agg(F.count("*").alias("k"))
    values = held.groupBy("tell").agg(F.countDistinct("value").alias("v"))
    overall = long.groupBy("tell", "value").agg(F.count("*").alias("k_all"))
    totals = long.groupBy("tell").agg(F.count("*").alias("n_all"))
    sizes = sorted(((r["label"], r["n"]) for r in n_label.collect()), key=lambda x: (x[0] is not None, x[0]))  # one row a class
    classes = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(n).alias("n")) for x, n in sizes])).alias("c")
    grid = overall.select("*", classes).select("tell", "value", "k_all", "c.label", "c.n").join(held, ["label", "tell", "value"], "left").join(values, "tell").join(totals, "tell")
    model = grid.select("label", "tell", "value", F.log((F.coalesce("k", F.lit(0)) + 1.0) / (F.col("n") + F.col("v"))).alias("lp"), (-F.log((F.col("k_all") + 1.0) / (F.col("n_all") + F.col("v")))).alias("surprise"))
    total = rows.count()
    # The model is a vocabulary: it goes to the rows, a row a key is all that is shuffled, in tasks of a fixed number of rows.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + total // TASK_ROWS
    scored = rows.select(key, *[F.col(t).cast("string").alias(f"_v{j}") for j, t in enumerate(tells)])
    for j, t in enumerate(tells):
        said = model.where(F.col("tell") == t).groupBy(F.col("value").alias(f"_v{j}")).agg(F.max("surprise").alias(f"_s{j}"), *[F.max(F.when(F.col("label").eqNullSafe(F.lit(x)), F.col("lp"))).alias(f"_p{j}_{i}") for i, (x, _) in enumerate(sizes)])
        scored = scored.join(F.broadcast(said), f"_v{j}", "left")
    surest = F.array_compact(F.array(*[F.col(f"_s{j}") for j in range(len(tells))]))
    sums = [sum((F.coalesce(f"_p{j}_{i}", F.lit(0.0)) for j in range(len(tells))), F.lit(0.0)).alias(f"_l{i}") for i in range(len(sizes))]
    scored = scored.select(key, F.array_max(surest).alias("novelty"), *sums).where("novelty is not null").repartition(parts, key)
    scored = scored.groupBy(key).agg(F.max("novelty").alias("novelty"), *[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(len(sizes))])
    told = [F.struct((F.col(f"_l{i}") + F.log(F.lit(n) / F.lit(float(total)))).alias("lp"), F.lit(-i).alias("order"), F.lit(x).alias("label")) for i, (x, n) in enumerate(sizes) if x is not None]
    if not told:
        return scored.select(key, F.lit(None).cast("string").alias("guess"), F.lit(None).cast("double").alias("log_p"), "novelty").limit(0)
    return scored.withColumn("best", F.array_max(F.array(*told))).select(key, F.col("best.label").alias("guess"), F.col("best.lp").alias("log_p"), "novelty")


def held_out_auc(train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> float | None:
    """AUC of a stacker on rows it was not fitted to; None where either side has one class only."""
    from tracewright.functions.metrics import auc

    if min(d.select(label).distinct().count() for d in (train, test)) < 2:
        return None
    w, b = stacker(train, features, label)
    return auc(stacked(test, w, b), "risk", label).first()["auc"]


def ablation(train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """feature, alone, without: held-out AUC of each signal by itself, and of all the others."""
    rows = [(f, held_out_auc(train, test, [f], label), held_out_auc(train, test, [g for g in features if g != f] or [f], label)) for f in features]
    return train.sparkSession.createDataFrame(rows, "feature string, alone double, without double")  # one row a feature


def open_set(scored: DataFrame, known: DataFrame, least_tells: int = 4, quantile: float = 0.99) -> DataFrame:
    """scored (txid, guess, novelty, n_tells) with answer: unknown where there are too few tells, or a transaction is more novel than that quantile of known ones."""
    edge = quantiles(known, "novelty", [quantile])[0]
    few, odd = F.col("n_tells") < least_tells, F.col("novelty") > F.lit(edge)
    return scored.withColumn("answer", F.when(few | odd, "unknown").otherwise(F.col("guess")))


def reasons(alerts: DataFrame, found: DataFrame, tainted: DataFrame, leads: DataFrame, most: int = 5) -> DataFrame:
    """entity, risk, patterns, reasons: each alert with its rules' and taint's reasons, strongest first, and its leads, at most a number of each."""
    listed = lambda rows, c: F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col(c).alias("v")))), lambda x: x["v"]), 1, most)
    rules = found.groupBy("entity").agg(listed(found, "reason").alias("why"), F.array_sort(F.collect_set("rule")).alias("patterns"))
    near = tainted.select(F.col("node").alias("entity"), F.format_string("%d hops from a watched wallet", F.col("hops").cast("int")).alias("near"))
    hosts = leads.groupBy("entity").agg(listed(leads, "ip").alias("leads"))
    rows = alerts.join(rules, "entity", "left").join(near, "entity", "left").join(hosts, "entity", "left")
    none = F.array().cast("array<string>")
    hint = F.when(F.col("near").isNotNull(), F.array("near")).otherwise(none)
    return rows.select("entity", "risk", F.coalesce("patterns", none).alias("patterns"), F.concat(F.coalesce("why", none), hint).alias("reasons"), F.coalesce("leads", none).alias("leads"))
