"""Isotonic maps of many keys in one pass, and models that each leave one class out, from one pair of count tables.

Isotonic regression by pool-adjacent-violators is mergeable: pooling the violators of a range first and then those of the
ranges' blocks gives the same fit. So rows are counted by value, dealt out by ranges of (keys, value), pooled where they lie,
and only blocks meet.

A categorical naive Bayes with Laplace smoothing is its counts; the model without a class is the same counts without that
class's, with the vocabulary and the priors that remain. No model is fitted twice.

Defined results: null values and null targets are left out; equal values are one; a row without tells is judged by the priors;
tells that the rest has never seen say nothing; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.tells import CONSTRUCTION, TELLS, defining
from tracewright.session import written

#: Fixed values.
NOVELTY, DEFINING, LEAST_TELLS, UNKNOWN_BELOW = 0.99, 0.8, 4, 0.5
_UNSEEN = "unseen"


def _pool(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Pooled blocks (key, lo, hi, sum, n) of blocks in order of key and lo."""
    held: list[list] = []
    for key, lo, hi, total, n in blocks:
        if held and held[0][0] != key:
            yield from map(tuple, held)
            held = []
        held.append([key, lo, hi, total, n])
        while len(held) > 1 and held[-2][3] * held[-1][4] >= held[-1][3] * held[-2][4]:
            _, _, hi, total, n = held.pop()
            held[-1][2:] = [hi, held[-1][3] + total, held[-1][4] + n]
    yield from map(tuple, held)


def isotonic(rows: DataFrame, keys: list[str], x: str, y: str, times: Column | None = None) -> DataFrame:
    """keys, xs, ys: for each key the non-decreasing least-squares fit of y over x, as the ends of its steps. A row counts times times."""
    times = F.lit(1) if times is None else times
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    ddl = f"{kinds}, lo double, hi double, total double, n double"
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("lo"))
    held = held.agg(F.sum(F.col(y).cast("double") * times).alias("total"), F.sum(times).cast("double").alias("n"))
    dealt = held.repartitionByRange(*keys, "lo").sortWithinPartitions(*keys, "lo")

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            hi = f["hi"] if "hi" in f else f["lo"]
            yield from zip(zip(*(f[k] for k in keys), strict=True), f["lo"], hi, f["total"], f["n"], strict=True)

    def framed(blocks: Iterator[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*k, *b) for k, *b in blocks], columns=[*keys, "lo", "hi", "total", "n"])

    parts = dealt.mapInPandas(lambda frames: iter([framed(_pool(rest(frames)))]), ddl)
    whole = parts.groupBy(*keys).applyInPandas(lambda f: framed(_pool(rest(iter([f.sort_values("lo")])))), ddl)
    step = F.struct("lo", "hi", (F.col("total") / F.col("n")).alias("y"))
    steps = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("s"))
    ends = F.flatten(F.transform("s", lambda s: F.when(s["lo"] == s["hi"], F.array(F.struct(s["lo"].alias("x"), s["y"]))).otherwise(F.array(F.struct(s["lo"].alias("x"), s["y"]), F.struct(s["hi"].alias("x"), s["y"])))))
    return steps.select(*keys, ends.alias("e")).select(*keys, F.col("e.x").alias("xs"), F.col("e.y").alias("ys"))


def mapped(x: Column, xs: Column, ys: Column) -> Column:
    """The fit at x: linear between ends, flat beyond them; x itself without a fit."""
    below = F.size(F.filter(xs, lambda v: v <= x))
    at = lambda a, k: F.element_at(a, F.greatest(k, F.lit(1)))
    x0, x1, y0, y1 = at(xs, below), F.try_element_at(xs, below + 1), at(ys, below), F.try_element_at(ys, below + 1)
    return F.when(xs.isNull(), x).when(below == 0, at(ys, F.lit(1))).when(x1.isNull() | (x0 == x1), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def _long(rows: DataFrame, *keep: str) -> DataFrame:
    x = F.explode(F.array(*[F.struct(F.lit(t).alias("tell"), F.col(t).cast("string").alias("value")) for t in TELLS])).alias("x")
    return rows.select(*keep, x).select(*keep, "x.tell", "x.value").where("value is not null")


def left_out(train: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The models of all folds (a fold leaves its class out): fold, label, prior; and fold, label, tell, word, lp.

    train: label and the tells, and n if a row stands for several. word is 'v' and a value, or 'unseen' for values that no
    class has.
    """
    train = train if "n" in train.columns else train.withColumn("n", F.lit(1))
    n = train.groupBy("label").agg(F.sum("n").alias("n"))
    sizes = {r["label"]: r["n"] for r in n.collect()}  # one row a class
    every = lambda name: F.explode(F.array(*[F.lit(x) for x in sorted(sizes)])).alias(name)
    if not sizes:
        spark = train.sparkSession
        return spark.createDataFrame([], "fold string, label string, prior double"), spark.createDataFrame([], "fold string, label string, tell string, word string, lp double")
    total = float(sum(sizes.values()))
    left = n.select(F.col("label").alias("fold"), F.col("n").alias("gone"))
    priors = n.select("label", "n", every("fold")).where("fold <> label").join(left, "fold").select("fold", "label", F.log(F.col("n") / (F.lit(total) - F.col("gone"))).alias("prior"))
    held = written(_long(train, "label", "n").groupBy("label", "tell", F.concat(F.lit("v"), "value").alias("word")).agg(F.sum("n").alias("c")), "openset-counts")
    totals = held.groupBy("label", "tell").agg(F.sum("c").alias("t"))
    words = held.groupBy("tell", "word").agg(F.sum("c").alias("all"))
    words = words.unionByName(held.select("tell").distinct().select("tell", F.lit(_UNSEEN).alias("word"), F.lit(0).cast("long").alias("all")))
    own = held.select(F.col("label").alias("fold"), "tell", "word", F.col("c").alias("own"))
    words = words.select("*", every("fold")).join(own, ["fold", "tell", "word"], "left").withColumn("in", (F.col("all") > F.coalesce("own", F.lit(0))).cast("int"))
    words = words.withColumn("v", F.sum("in").over(Window.partitionBy("fold", "tell"))).where("v > 0")  # one row a word of the vocabulary
    grid = words.select("fold", "tell", "word", "in", "v", every("label")).where("fold <> label").join(held, ["label", "tell", "word"], "left").join(totals, ["label", "tell"], "left")
    p = (F.coalesce("c", F.lit(0)) + alpha) / (F.coalesce("t", F.lit(0)) + alpha * (F.col("v") + 1 - F.col("in")))
    return written(priors, "openset-priors"), written(grid.select("fold", "label", "tell", "word", F.log(p).alias("lp")), "openset-grid")


def judged(rows: DataFrame, priors: DataFrame, grid: DataFrame) -> DataFrame:
    """key, view, fold, label, p, worst: the posterior of every label, and the largest surprise under it, of rows (key, view, fold, tells)."""
    long = _long(rows, "key", "view", "fold").withColumn("word", F.concat(F.lit("v"), "value"))
    seen = grid.select("tell", "word").distinct().withColumn("known", F.lit(True))
    long = long.join(seen, ["tell", "word"], "left").withColumn("word", F.when(F.col("known"), F.col("word")).otherwise(_UNSEEN))
    sums = long.join(grid, ["fold", "tell", "word"]).groupBy("key", "view", "fold", "label").agg(F.sum("lp").alias("lp"), F.max(-F.col("lp")).alias("worst"))
    out = rows.select("key", "view", "fold").join(priors, "fold").join(sums, ["key", "view", "fold", "label"], "left")
    out = out.withColumn("lp", F.col("prior") + F.coalesce("lp", F.lit(0.0)))
    w = Window.partitionBy("key", "view", "fold")  # one row a label
    p = F.exp(F.col("lp") - F.max("lp").over(w))
    return out.select("key", "view", "fold", "label", (p / F.sum(p).over(w)).alias("p"), F.coalesce("worst", F.lit(0.0)).alias("worst"))


def _views(rows: DataFrame) -> DataFrame:
    """Each row as it is, and as a source without construction fields shows it; cond: what it then is to a model."""
    bare = rows.withColumns({c: F.lit(None).cast("string") for c in CONSTRUCTION})
    both = rows.withColumn("view", F.lit("full")).unionByName(bare.withColumn("view", F.lit("structural")))
    seen = sum((F.col(t).isNotNull().cast("int") for t in TELLS), F.lit(0))
    return both.withColumns({"cond": F.when(F.coalesce(*CONSTRUCTION).isNotNull(), "full").otherwise("structural"), "n_tells": seen})


def _named(scored: DataFrame, maps: DataFrame, *keep: str) -> DataFrame:
    """The label that each row's model names, with its calibrated chance q; scored has a column cond, the map to read."""
    q = scored.join(maps.withColumnRenamed("view", "cond"), ["fold", "cond"], "left").withColumn("q", mapped(F.col("p"), F.col("xs"), F.col("ys")))
    w = Window.partitionBy("key", "view", "fold").orderBy(F.col("q").desc(), F.col("p").desc(), "label")
    return q.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "view", "cond", "fold", F.col("label").alias("named"), "q", "worst", *keep)


def leave_one_out(rows: DataFrame, least_tells: int = LEAST_TELLS, unknown_below: float = UNKNOWN_BELOW) -> DataFrame:
    """held, view, model, transactions, unknown, shared, harmful: how models that never saw a class answer for it.

    rows: key, label, role (train, calibration, test) and the tells. For each class, counts, isotonic maps and novelty limits
    come from the train and calibration rows of the others. The open model answers unknown where the named label's least
    likely tell is more surprising than NOVELTY of the calibration rows, the closed one does not look; both do where tells are
    few or the chance is low. An answer is shared if the row shows every defining tell of the named class that can be told of
    it, one at least, else harmful. A model answers alike for like tells, so rows of one label, role and tells are one row with
    a count n (the tells are categories), and no row is judged by every class's model by itself.
    """
    alike = rows.groupBy(F.col("label").cast("string").alias("label"), "role", *[F.col(t).cast("string").alias(t) for t in TELLS]).agg(F.count("*").alias("n"))
    rows = written(alike.withColumn("key", F.monotonically_increasing_id()), "openset-rows")
    train = rows.where("role = 'train'")
    priors, grid = left_out(train)
    folds = priors.select("fold").distinct()
    cal = _views(rows.where("role = 'calibration'")).join(F.broadcast(folds), F.col("fold") != F.col("label"))  # one row a class
    truth = cal.select("key", "view", "fold", F.col("label").alias("truth"), "n")
    scored = written(judged(cal, priors, grid).join(truth, ["key", "view", "fold"]).withColumn("cond", F.col("view")), "openset-scored")
    maps = written(isotonic(scored.withColumn("y", (F.col("label") == F.col("truth")).cast("double")), ["fold", "view"], "p", "y", F.col("n")), "openset-maps")
    limits = _named(scored, maps, "n").groupBy("fold", "cond").agg(F.percentile("worst", F.lit(NOVELTY), F.col("n")).alias("limit"))
    test = _views(rows.where("role = 'test'")).withColumn("fold", F.col("label"))
    said = judged(test, priors, grid).join(test.select("key", "view", "fold", "cond", "n_tells", "n"), ["key", "view", "fold"])
    named = _named(said, maps, "n_tells", "n").join(limits, ["fold", "cond"], "left")
    marks = defining(train.select("label", "n", *TELLS), least=DEFINING).select(F.col("label").alias("named"), "tell", F.col("value").alias("mark"))
    shown = _long(test, "key", "view").join(named.select("key", "view", "named"), ["key", "view"]).join(marks, ["named", "tell"])
    shown = shown.groupBy("key", "view").agg(F.count("*").alias("marks"), F.sum((F.col("value") == F.col("mark")).cast("int")).alias("hits"))
    few = (F.col("n_tells") < least_tells) | (F.col("q") < unknown_below)
    novel = F.coalesce(F.col("worst") > F.col("limit"), F.lit(False))
    models = F.explode(F.array(F.struct(F.lit("closed").alias("model"), few.alias("unknown")), F.struct(F.lit("open").alias("model"), (few | novel).alias("unknown")))).alias("m")
    rows = named.join(shown, ["key", "view"], "left").select("fold", "view", "n", "marks", "hits", models).select("fold", "view", "n", "m.*", F.coalesce(F.col("marks") == F.col("hits"), F.lit(False)).alias("shared"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    u, s = F.col("unknown"), F.col("shared")
    return rows.groupBy(F.col("fold").alias("held"), "view", "model").agg(F.sum("n").alias("transactions"), count(u).alias("unknown"), count(~u & s).alias("shared"), count(~u & ~s).alias("harmful"))
