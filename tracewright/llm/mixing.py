"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words: the weights share out all words, no target passes ``MAX_COPIES`` times its source's
size, and what that cuts off is shared out again by weight. Each document of a source then has the same fractional
number of copies; its whole part is certain, and the fractional parts are rounded in pairs: mass moves from one document
to the other, in a random direction that keeps both expectations, until one of them is whole, while the words of the
pair stay the same. A block of documents so ends with one fractional document at most. Blocks are reduced in a tree
(``FAN_IN`` residuals at a time) until one document per source is left, which a last draw settles: a source misses its
target by less than that one document. Its last group is paired in ``TRIES`` seeded orders, and the one that ends nearest
the target stands, which brings the miss near the size of a small document.

A source holding a third of all rows is many blocks (``BLOCK`` documents each, by a hash of doc_id), never one group.
Draws are seeded by source and block, so reruns agree.

Defined results: null and blank texts have size 0 and take 0 words; texts may be of any length; a null source is a source
of its own, last in order; a null doc_id stays null and any other is kept to its last digit; repeated rows are rounded as
separate documents (``mixed`` gives rows that share a doc_id the larger count); an empty table gives an empty result;
other columns are ignored, whatever their names, and ``mixed`` returns them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 4096
FAN_IN = 1024
TRIES = 24
_EPS = 1e-9
#: A null id travels as 0 and a flag: pandas would turn the whole column into floating point.
_ROW = "doc long, no_id boolean, source string, skey string, block long, size long, source_size long, target double, copies double"


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey (never null), size in words."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source")).alias("skey"),
        size.alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """One row a source: skey, source_size, n_docs, target. The windows run over sources, already summed up."""
    by = sized.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = by.withColumn("fill", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("fill", "skey").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    # The level at which targets = min(weight * level, cap) add up to all words: sources fill up in order of cap / weight.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    )
    by = by.withColumn("at", level)
    reached = F.min(F.when(F.col("at") <= F.col("fill"), F.struct("fill", "skey", "at"))).over(every)["at"]
    by = by.withColumn("level", F.coalesce(reached, zero))
    return by.select(
        "skey", "source_size", "n_docs", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target")
    )


def _pivot(rows: pd.DataFrame, turn: int = 0) -> pd.DataFrame:
    """Round the copies of one group's rows in pairs; one row at most keeps a fraction. turn: another seeded order and draw."""
    rows = rows.sort_values(["size", "doc", "no_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    seed = xxhash.xxh64_intdigest(f"{rows.skey.iloc[0]}|{rows.block.iloc[0]}|{len(rows)}|{rows.doc.iloc[0]}", seed=turn)
    random = np.random.default_rng(seed)
    draw = random.random(len(rows))
    size = rows["size"].to_numpy(float)
    whole = np.floor(rows["copies"].to_numpy(float) + _EPS)
    part = np.clip(rows["copies"].to_numpy(float) - whole, 0.0, 1.0)
    part[part < _EPS] = 0.0
    free = size <= 0  # these carry no words: rounded to the nearest, nothing to balance
    part[free] = (part[free] >= 0.5).astype(float)
    open_at = -1
    some = np.flatnonzero((part > 0) & (part < 1))
    for j in random.permutation(some) if turn else some:
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up = min(size[i] * (1 - part[i]), size[j] * part[j])
        down = min(size[i] * part[i], size[j] * (1 - part[j]))
        moved = up if draw[j] * (up + down) < down else -down
        part[i] += moved / size[i]
        part[j] -= moved / size[j]
        for k in (i, j):
            if part[k] < _EPS or part[k] > 1 - _EPS:
                part[k] = round(part[k])
        left = [k for k in (i, j) if 0 < part[k] < 1]
        open_at = left[0] if left else -1
    rows["copies"] = whole + part
    return rows


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The last draw for what is left of a source."""

    def drawn(turn: int) -> tuple[float, pd.DataFrame]:
        out = _pivot(rows, turn)
        before, whole = out["copies"].to_numpy(float), np.floor(out["copies"])
        draw = [xxhash.xxh64_intdigest(f"{s}|last|{d}|{turn}") / 2**64 if f else 1.0 for s, d, f in zip(out.skey, out.doc, before > whole, strict=True)]
        out["copies"] = whole + (np.asarray(draw) < before - whole)
        return abs(float(((out["copies"] - before) * out["size"]).sum())), out

    return min((drawn(turn) for turn in range(TRIES)), key=lambda x: x[0])[1]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row of docs."""
    sized = written(with_sizes(docs), "mix-sizes")
    plan = written(targets(sized, weights, most), "mix-targets")
    blocks = F.ceil(F.col("n_docs") / BLOCK)
    level = (
        sized.join(plan, "skey")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("mix")), blocks))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumns({"doc": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
        .select(*[c.split()[0] for c in _ROW.split(", ")])
    )
    top = plan.agg(F.max(blocks)).first()[0] or 0
    done = None
    while top > 0:
        rounded = written(level.groupBy("skey", "block").applyInPandas(_settle if top <= 1 else lambda rows: _pivot(rows), _ROW), "mix-level")
        whole = rounded.where(F.col("copies") == F.floor("copies"))
        done = whole if done is None else done.unionByName(whole)
        level = rounded.where(F.col("copies") != F.floor("copies")).withColumn(
            "block", F.floor(F.col("block") / FAN_IN).cast("long")
        )
        top = 0 if top <= 1 else -(-top // FAN_IN)
    done = level if done is None else done
    return done.select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"), "source",
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that share a doc_id share the larger count."""
    copies = mix(docs, weights, most).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("n")).where("n > 0")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
