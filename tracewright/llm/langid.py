"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

Features are hashed letter trigrams of the whole lower-cased text (``DIMENSIONS`` bins of UTF-8 trigrams, square roots of
counts, unit length). The SVMs are fitted by Spark ML, ``AT_ONCE`` of them side by side, on a bounded sample of the
labelled training rows: about ``PER_LANGUAGE`` documents of each language, picked by a hash of doc_id. Prediction is a map
over all rows, no shuffle.

Families come from a fixed table; a language that is not in it is a family of its own.

Defined results: a null text, a text without letters, or no training rows at all give ``und`` with score 0; repeated rows
each get a row; texts may be of any length; an empty table gives no rows; other columns are ignored, whatever their
names. Only text is an input of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import written

DIMENSIONS = 8192
PER_LANGUAGE = 500
AT_ONCE = 8
#: Language code -> family.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "nb": "germanic", "nn": "germanic", "is": "germanic", "af": "germanic", "fr": "romance", "es": "romance",
    "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance", "ru": "slavic", "uk": "slavic",
    "be": "slavic", "bg": "slavic", "sr": "slavic", "mk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
    "sl": "slavic", "hr": "slavic", "bs": "slavic", "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic",
    "az": "turkic", "kk": "turkic", "uz": "turkic", "ar": "semitic", "he": "semitic", "hi": "indic", "bn": "indic",
    "ur": "indic", "mr": "indic", "ne": "indic", "zh": "sinitic", "ja": "japonic", "ko": "koreanic", "lt": "baltic",
    "lv": "baltic", "el": "hellenic", "id": "malayic", "ms": "malayic",
}
_OTHER = re.compile(r"[\W\d_]+")


def counts(text: str | None) -> np.ndarray | None:
    """Trigram counts of a text, None without letters."""
    if not text:
        return None
    letters = _OTHER.sub(" ", text.lower()).strip()
    if not letters:
        return None
    b = np.frombuffer(f" {letters} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)).astype(np.uint32)
    h ^= h >> np.uint32(15)
    return np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (DIMENSIONS.bit_length() - 1)), minlength=DIMENSIONS)


def vector(text: str | None) -> np.ndarray | None:
    n = counts(text)
    if n is None:
        return None
    v = np.sqrt(n)
    return v / np.linalg.norm(v)


@dataclass
class Model:
    """families[i] against the others: column i of family_w; pairs (a, b): column of pair_w is positive for a."""

    families: list[str]
    languages: dict[str, list[str]]
    family_w: np.ndarray
    family_b: np.ndarray
    pairs: list[tuple[str, str]]
    pair_w: np.ndarray
    pair_b: np.ndarray

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        sure = lambda m: 1.0 / (1.0 + np.exp(-np.clip(2 * m, -30, 30)))
        f = x @ self.family_w + self.family_b
        p = x @ self.pair_w + self.pair_b
        at = {pair: k for k, pair in enumerate(self.pairs)}
        out = []
        for fi, pi in zip(f, p, strict=True):
            top = int(np.argmax(fi))
            margin = float(fi[top])
            members = self.languages[self.families[top]]
            votes = {a: [0, 0.0] for a in members}
            for a, b in combinations(members, 2):
                m = float(pi[at[a, b]])
                won, lost = (a, b) if m >= 0 else (b, a)
                votes[won][0] += 1
                votes[won][1] += abs(m)
                votes[lost][1] -= abs(m)
            best = max(members, key=lambda a: (*votes[a], a))
            rivals = [abs(float(pi[k])) for pair, k in at.items() if best in pair and set(pair) <= set(members)]
            out.append((best, float(sure(margin) * sure(min(rivals)) if rivals else sure(margin))))
        return out


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    held = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not held:
        return rows.limit(0)
    share = F.create_map(*[F.lit(v) for k, n in held.items() for v in (k, min(1.0, per_language / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(u < F.element_at(share, F.col("lang")))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from rows of doc_id, text, lang; None if nothing can be learnt."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                found = [(lang, v) for lang, t in zip(*(part.column(c).to_pylist() for c in ("lang", "text")), strict=True) if (v := vector(t)) is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.string()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["lang", "x"]
                )

    rows = _sample(labelled.where("lang is not null").select("doc_id", "text", "lang"), per_language)
    rows = written(rows.select("text", "lang").mapInArrow(featurise, "lang string, x array<double>"), "langid-sample")
    langs = sorted(x["lang"] for x in rows.select("lang").distinct().collect())
    if not langs:
        return None
    family = {a: FAMILY.get(a, f"={a}") for a in langs}
    families = sorted(set(family.values()))
    by = {f: [a for a in langs if family[a] == f] for f in families}
    rows = rows.select("lang", array_to_vector("x").alias("features")).persist()

    def svm(among: list[str], positive: list[str]) -> tuple[np.ndarray, float]:
        part = rows.where(F.col("lang").isin(*among))
        part = part.withColumn("label", F.col("lang").isin(*positive).cast("double"))
        m = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(part)
        return m.coefficients.toArray(), m.intercept

    pairs = [p for f in families for p in combinations(by[f], 2)]
    split = [] if len(families) == 1 else families[:1] if len(families) == 2 else families
    asked = [(langs, by[f]) for f in split] + [(list(p), [p[0]]) for p in pairs]
    try:
        rows.count()
        with ThreadPoolExecutor(AT_ONCE) as pool:
            fitted = list(pool.map(lambda x: svm(*x), asked))
    finally:
        rows.unpersist()
    fam, pair = fitted[: len(split)], fitted[len(split) :] or [(np.zeros(DIMENSIONS), 0.0)]
    if len(families) == 1:
        fam = [(np.zeros(DIMENSIONS), 1.0)]
    elif len(families) == 2:
        fam = [fam[0], (-fam[0][0], -fam[0][1])]
    stack = lambda ws: (np.stack([w for w, _ in ws], 1).astype(np.float32), np.array([b for _, b in ws], np.float32))
    return Model(families, by, *stack(fam), pairs, *stack(pair))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x (families + pairs) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got: list[tuple[str, float]] = []
            for k in range(0, len(texts), 256):
                found = [vector(t) if m else None for t in texts[k : k + 256]]
                some = [v for v in found if v is not None]
                said = iter(m.predict(np.stack(some).astype(np.float32))) if some else iter(())
                got += [next(said) if v is not None else ("und", 0.0) for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([a for a, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
