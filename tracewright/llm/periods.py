"""Maximal periodic runs of words, by the runs theorem, and texts with the runs collapsed.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; kept are those of at least
``SHORTEST`` words and ``EXPONENT`` periods. Every run has a Lyndon root, which is the longest Lyndon word at its place under
the order of words or under the reversed order. Those words end at the next smaller value of the inverse suffix array, under
the reversed order at the next greater one (the end of a text is smaller than any word under the first, greater under the
second). Each such word is stretched to both sides by the longest common extension of its start and its end: a range minimum
over the LCP array, of the text and of the reversed text. The sparse table holds minima of blocks, so its memory is linear.

Whole texts go to tasks as they come, without a shuffle; the texts of a slice of some MB share one suffix array, in which a
text's number is the first key, so that copies cost nothing. Texts without two equal 5-grams have no run of that length
(a run repeats at least five of its words a period later) and skip the suffix array.

Defined results: null, empty and blank texts have no runs and collapse to the empty text; a text is held by one task as a whole,
at about 200 bytes a word where it has runs; repeated rows each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.slices import sliced

EXPONENT = 4
SHORTEST = 6
#: Words that a run of EXPONENT periods and SHORTEST words repeats one period later, at least.
_GRAM = 5
SLICE_BYTES = 2 << 20
_BLOCK = 32
SPLIT = r"[\x20\x09-\x0D]+"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class RangeMin:
    """Minima of ranges: inside blocks by running minima from both ends, across them by a sparse table."""

    def __init__(self, a: np.ndarray):
        self.a = np.pad(a, (0, -len(a) % _BLOCK), constant_values=np.iinfo(a.dtype).max)
        m = self.a.reshape(-1, _BLOCK)
        self.first = np.minimum.accumulate(m, axis=1).ravel()
        self.last = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [m.min(axis=1)]
        while 2 << (k := len(self.table) - 1) <= len(m):
            self.table.append(np.minimum(self.table[-1][: -(1 << k)], self.table[-1][1 << k :]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over lo..hi, both included."""
        a, b = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.last[lo], self.first[hi])
        for at in [np.flatnonzero(a == b)]:
            if len(at):
                out[at] = self.a[lo[at]]
                for step in range(1, _BLOCK):
                    out[at] = np.minimum(out[at], self.a[np.minimum(lo[at] + step, hi[at])])
        inner = b - a - 1
        level = np.where(inner > 0, np.frexp(np.maximum(inner, 1))[1] - 1, -1)
        for k in range(len(self.table)):
            if len(at := np.flatnonzero(level == k)):
                out[at] = np.minimum(out[at], np.minimum(self.table[k][a[at] + 1], self.table[k][b[at] - (1 << k)]))
        return out


def suffixes(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of first, each text's end being a value of its own; prefix doubling over unsettled ones."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    places = np.arange(n)

    def heads(keys: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], keys[1:] != keys[:-1]])

    def shared(head: np.ndarray) -> np.ndarray:
        return ~(head & np.concatenate([head[1:], [True]]))

    head = heads(first[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, places, 0))
    at = np.flatnonzero(shared(head))
    step = 1
    while len(at):
        own = order[at]
        keys = rank[own] * n + rank[own + step]
        o = np.argsort(keys, kind="stable")
        own, keys = own[o], keys[o]
        order[at] = own
        head = heads(keys)
        rank[own] = np.maximum.accumulate(np.where(head, at, 0))
        at = at[shared(head)]
        step *= 2
    return order, rank


class Extensions:
    """Longest common extensions to the right."""

    def __init__(self, first: np.ndarray):
        self.first = first
        self.order, self.rank = suffixes(first)
        self.minima: RangeMin | None = None

    def _lcp(self) -> np.ndarray:
        """Common prefixes of neighbours in the suffix array."""
        words, order, rank = self.first.tolist(), self.order.tolist(), self.rank.tolist()
        out, k = [0] * len(words), 0
        for i, r in enumerate(rank):
            if r == 0:
                k = 0
                continue
            j = order[r - 1]
            while words[i + k] == words[j + k]:  # no two ends are equal
                k += 1
            out[r] = k
            k = k - 1 if k else 0
        return np.array(out, np.int64)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.minima = self.minima or RangeMin(self._lcp())
        a, b = self.rank[i], self.rank[j]
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b))


def next_smaller(values: list[int]) -> np.ndarray:
    """Place of the next smaller value; the length where there is none."""
    out, open_ = [len(values)] * len(values), []
    for i, x in enumerate(values):
        while open_ and values[open_[-1]] > x:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row, told apart by their number and closed by an end of their own; the text of each place; starts and ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.concatenate([x for t in texts for x in (t + 1, [0])]).astype(np.int64)
    return words + text * (int(words.max()) + 1), text, ends - sizes, ends


def _roots(first: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of the longest Lyndon words of both orders that may be roots."""
    found, n = [], len(first)
    for values, last in ((rank, ends), (-rank, ends - 1)):
        i, end = np.arange(n), next_smaller(values.tolist())
        i = np.flatnonzero((i < ends[text]) & (end <= last[text]) & (exponent * (end - i) <= (ends - starts)[text]))
        p = (end - np.arange(n))[i]
        for k in range(_GRAM):  # the extension is at least so long: most words end here
            j = i + p + k
            same = (j < n) & (first[np.minimum(i + k, n - 1)] == first[np.minimum(j, n - 1)])
            i, p = i[same], p[same]
        found.append(i * n + p)
    both = np.unique(np.concatenate(found))
    return both // n, both % n


def runs_in(texts: list[np.ndarray], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each text of word numbers its runs (start, length, period), by start, then period."""
    first, text, starts, ends = _joined(texts)
    right = Extensions(first)
    i, p = _roots(first, text, starts, ends, right.rank, exponent)
    stop = i + p + right(i, i + p) if len(i) else i
    # A run's first root lies within its first period; what follows repeats a period later.
    wide = stop - i - p >= (exponent - 2) * p + 1
    i, p, stop, own = i[wide], p[wide], stop[wide], text[i[wide]]
    if not len(i):
        return [np.zeros((0, 3), np.int64)] * len(texts)
    has = np.unique(own)
    back, _, begins, _ = _joined([texts[t][::-1] for t in has.tolist()])
    left = Extensions(back)
    mirror = begins[np.searchsorted(has, own)] + ends[own] - 1  # word x of a text stands at mirror - x backwards
    before = np.zeros(len(i), np.int64)
    some = i > starts[own]
    before[some] = left((mirror - i + 1)[some], (mirror - i - p + 1)[some])
    start, length = i - before - starts[own], stop - i + before
    long = length >= np.maximum(shortest, exponent * p)
    rows = np.unique(np.stack([own, start, p, length], axis=1)[long], axis=0)
    cut = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).tolist()
    return [rows[a:b, [1, 3, 2]] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _repeating(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some 5-gram stands twice (and, rarely, of others: grams are hashed)."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = len(codes) - _GRAM + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(_GRAM):
        h = (h ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bits = np.uint64(max(1, int(len(sizes)).bit_length()))
    whole = text[:n] == text[_GRAM - 1 :]
    keys = np.sort((h >> bits << bits | text[:n].astype(np.uint64))[whole])
    return np.unique(keys[1:][keys[1:] == keys[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _slice(raw: list[bytes | None], exponent: int, shortest: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed texts."""
    words = [(x or b"").split() for x in raw]  # bytes split at \x20 and \x09-\x0D alone
    sizes = np.array([len(w) for w in words], np.int64)
    codes = pd.factorize(np.array([x for w in words for x in w], object))[0].astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    runs = [np.zeros((0, 3), np.int64)] * len(raw)
    some = _repeating(codes, sizes).tolist()
    if some:
        for t, found in zip(some, runs_in([codes[starts[t] : starts[t] + sizes[t]] for t in some], exponent, shortest), strict=True):
            runs[t] = found
    out = []
    for w, found in zip(words, runs, strict=True):
        if len(found):
            edges = np.zeros(len(w) + 1, np.int64)
            np.add.at(edges, found[:, 0] + found[:, 2], 1)
            np.add.at(edges, found[:, 0] + found[:, 1], -1)
            w = [w[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        out.append(b" ".join(w))
    return runs, out


def collapsed(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), collapsed: the text without all but the first
    period of each run, its words joined by a space."""
    if shortest < SHORTEST or exponent < EXPONENT:
        raise ValueError("runs have 6 words and 4 periods at least: shorter ones need not repeat a 5-gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            for a, b in sliced(raw, SLICE_BYTES):
                runs, texts = _slice(raw.slice(a, b - a).to_pylist(), exponent, shortest)
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, pa.array(texts, pa.binary())], ["doc_id", "runs", "collapsed"])
            del raw, batch
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    out = rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in each tenth document, by its id's checksum, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text").cast("string"), SPLIT), lambda x: x != "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.when(h % 10 == 0, g).alias("_g"))
    rows = rows.withColumn("_w", F.when(F.col("_g").isNotNull(), words)).withColumn("_n", F.size("_w"))
    a = "cast(_g % _n as int)"
    p = f"(1 + (_n - {a}) div (3 + _g % 8))"
    text = f"array_join(transform(sequence(0, _n - 1), i -> if(i < {a}, _w[i], _w[cast({a} + (i - {a}) % {p} as int)])), ' ')"
    return rows.select("doc_id", F.expr(f"if(_n > 0, {text}, text)").alias("text"))


def best(runs: Column) -> Column:
    """The run of greatest exponent; of equal ones the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda m, r: m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"])
    return F.aggregate(runs, none, lambda m, r: F.when(more(m, r), r).otherwise(m))


def digest(docs: DataFrame) -> DataFrame:
    rows = collapsed(planted(docs)).withColumn("_b", best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period",
        F.expr("_b.length * 1000 div _b.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_periods(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
