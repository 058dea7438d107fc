"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. One pass hashes each document's word shingles, takes the set's signature and adds the shingles to a count sketch of
   fixed size (``SKETCH`` counters, summed over all documents). Equal sets become one class.
2. A second pass orders each class's shingles rare first (sketch count, then hash: one total order for all documents) and
   emits its prefix. A task emits a class once, so a group of copies is a few rows a shingle, however large it is.
3. Lists of classes that share a prefix shingle yield candidates, cut by length and position, then by the suffix filter:
   behind a common shingle at places i and j, two sets share at most the sum, over hash ranges, of the smaller counts of
   what stands behind those places, and before it at most min(i, j). A pair that is left is verified on the whole sets.

Links first have to be followed, not listed, so lists go in rounds, and no pair is judged in two of them. First the classes
of a list that have one size meet a pivot among them; then a member of the list's largest component meets all others
outside that component; last, what still lies across components is compared in chunks of ``CHUNK`` classes, inside a task,
which puts out only the pairs that pass all filters. A large group of near copies thus costs a multiple of its size, not
its square. No pair of classes in different components is left out, so components are those of all links.

``joined`` adds the number of links: a component's classes are compared in blocks (``BLOCK_SETS`` sets) by matrix products
of shingle incidence, every pair of the component whose sizes allow a link, and a task puts out one number a class, never
its pairs. ``pairs`` lists the links themselves, for who wants all of them.

Any order of shingles gives the same links: the sketch decides speed alone. Shingles are 64-bit hashes.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; fewer words than a shingle
make one shingle of all words; texts may be of any length; repeated rows link as copies; a null doc_id takes part but is
no component's id unless all its members are null; an empty table gives no rows; other columns are ignored, whatever
their names, and ``one_of_each`` returns them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators.components import components
from tracewright.session import written

SKETCH = 1 << 20
CHUNK = 256
BLOCK_SETS = 256
BLOCK_SHINGLES = 1 << 18
_SKETCH_PART = 1 << 12
#: Hash ranges of the suffix filter.
_RANGES = 512
#: Bits of the sketch of wanted ids, by which other documents stay where they are: 2 MB, whatever the input.
_WANTED_BITS = 24
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes | None, n: int) -> np.ndarray:
    """The set of hashed n-word shingles of a text, as sorted uint64."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _MUL
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _signature(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _range(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(55)).astype(np.int64)


def _histogram(h: np.ndarray) -> bytes:
    """The shingles of a set by hash range: four or two counts a byte where they fit, else one, 255 at most."""
    c = np.bincount(_range(h), minlength=_RANGES)
    each = 2 if c.max() < 4 else 4 if c.max() < 16 else 8
    c = np.minimum(c, 255).reshape(-1, 8 // each)
    return sum(c[:, k] << (each * k) for k in range(8 // each)).astype(np.uint8).tobytes()


def _counts(hist: bytes) -> np.ndarray:
    c = np.frombuffer(hist, np.uint8).astype(np.int64)
    per = _RANGES // len(c)
    each = 8 // per
    return np.stack([c >> (each * k) & ((1 << each) - 1) for k in range(per)], 1).ravel()


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    names = ["doc_id", "n", "cid", "hist", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                sets = [shingles(x, n) for x in some.column("raw").to_pylist()]
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH)
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([_signature(x) if len(x) else None for x in sets], pa.int64()),
                        pa.array([_histogram(x) if len(x) else None for x in sets], pa.binary()),
                        pa.nulls(k, pa.int32()),
                        pa.nulls(k, pa.binary()),
                    ],
                    names,
                )
        step = _SKETCH_PART
        rows = [(k // step, zlib.compress(total[k : k + step].astype("<i8").tobytes(), 1)) for k in range(0, SKETCH, step) if total[k : k + step].any()]
        k = len(rows)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 3, pa.nulls(k, pa.binary()), pa.array([a for a, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names)

    return written(docs.mapInArrow(run, "doc_id long, n long, cid long, hist binary, part int, counts binary"), "ngram-first")


def _sketch(first: DataFrame) -> np.ndarray:
    """The summed counters: SKETCH numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(blob), "<i8")
                sums[part] = sums[part] + got if part in sums else got
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    parts = first.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary")
    total = np.zeros(SKETCH, np.int64)
    for row in parts.collect():
        total[row["part"] * _SKETCH_PART : (row["part"] + 1) * _SKETCH_PART] = np.frombuffer(row["counts"], "<i8")
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def _prefix(h: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set that its prefix holds, rare first; h is sorted, so ties go by hash."""
    size = len(h)
    k = size - -(-percent * size // 100) + 1
    key = rarity[_bucket(h)]
    if k < size:
        near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])  # ties past the cut are sorted out below
        h, key = h[near], key[near]
    return h[np.argsort(key, kind="stable")[:k]]


def _postings(docs: DataFrame, rarity, n: int, percent: int) -> DataFrame:
    """token, cid, n, pos: each class's prefix, rare first. rarity: the sketch, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                tokens, cids, sizes, places = [], [], [], []
                for raw in batch.column("raw").slice(a, 512).to_pylist():
                    h = shingles(raw, n)
                    if not len(h) or (cid := _signature(h)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(cid)
                    p = _prefix(h, rarity.value, percent)
                    tokens.append(p)
                    cids.append(np.full(len(p), cid, np.int64))
                    sizes.append(np.full(len(p), len(h), np.int32))
                    places.append(np.arange(len(p), dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(cids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                        ["token", "cid", "n", "pos"],
                    )

    return docs.select("raw").mapInArrow(run, "token long, cid long, n int, pos int")


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id is a rep of wanted, and a few others: texts that nobody wants are dropped before they are shuffled."""
    at = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - _WANTED_BITS)  # noqa: E731  a null has a hash too
    one = wanted.select(at("rep").alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    words = F.broadcast(one.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    asked = rows.select("doc_id", "raw", at("doc_id").alias("at")).withColumn("word", F.shiftright("at", 6))
    return asked.join(words, "word").where(F.getbit("bits", F.col("at").bitwiseAND(63).cast("int")) == 1).select("doc_id", "raw")


def _sets(rows: DataFrame, classes: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """cid, items (packed set) of the classes ids (column cid): one document of each is hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                found = [(cid, h.tobytes()) for cid, raw in zip(some.column("cid").to_pylist(), some.column("raw").to_pylist(), strict=True) if len(h := shingles(raw, n)) and _signature(h) == cid]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([number + k for k in range(len(found))], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["cid", "u", "items"])
                number += len(found)

    wanted = written(classes.join(ids.select("cid").distinct(), "cid").select("cid", "rep"), "ngram-wanted")
    found = _maybe(rows, wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "raw").mapInArrow(run, "cid long, u long, items binary")
    found = written(found, "ngram-sets")
    # Rows that share a doc_id and a set give a class more than once.
    once = found.groupBy("cid").agg(F.min("u").alias("u"), F.count("*").alias("times"))
    if not once.where("times > 1").isEmpty():
        found = written(found.join(once.select("cid", "u"), ["cid", "u"]), "ngram-sets")
    return found.select("cid", "items")


def _need(a: str, b: str, percent: int) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _possible(na: str, pa_: str, nb: str, pb: str, percent: int) -> Column:
    """Length and positional filters for a shingle at these places of both orders."""
    long_enough = F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)
    rest = F.lit(1) + F.least(F.col(na) - F.col(pa_) - 1, F.col(nb) - F.col(pb) - 1)
    return long_enough & (rest >= _need(na, nb, percent))


def _behind(hist: bytes, gone: np.ndarray) -> np.ndarray:
    """How many shingles of each hash range stand behind a place, at most; a full counter says nothing.

    gone: hash ranges of the prefix's shingles up to that place that other prefixes hold too. Those no other prefix holds
    are in no other set before this place, so what they add to the bound does no harm but to its sharpness.
    """
    held = _counts(hist)
    return np.where(held < 255, held - np.bincount(gone, minlength=_RANGES), 1 << 30).astype(np.int32)


def _gone(before: list[int], pos: int) -> np.ndarray:
    """before, as info has it (place << 9 | hash range, in order), up to place pos."""
    at = np.asarray(before, np.int64)
    return at[: np.searchsorted(at, (pos + 1) << 9)] & (_RANGES - 1)


def _judged(pairs: DataFrame, info: DataFrame, sets_of, percent: int) -> DataFrame:
    """a, b, linked of each pair (a, b, pa, pb): by the suffix filter, then on the whole sets, which sets_of(ids) gives."""
    pairs = written(pairs, "ngram-pairs")
    side = lambda k: info.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("hist").alias(f"h{k}"), F.col("before").alias(f"q{k}"))

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, ha, hb, qa, qb, i, j in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ha", "hb", "qa", "qb", "pa", "pb")), strict=True):
                x, y = (_behind(h, _gone(q, k)) for h, q, k in ((ha, qa, i), (hb, qb, j)))
                most = min(i, j) + 1 + min(int(np.minimum(x, y).sum(dtype=np.int64)), na - i - 1, nb - j - 1)
                keep.append((100 + percent) * most >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "open"])

    tried = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(suffix, "a long, b long, open boolean"), "ngram-tried")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    left = tried.where("open").select("a", "b")
    sets = sets_of(left.select(F.col("a").alias("cid")).unionByName(left.select(F.col("b").alias("cid"))))
    rows = left.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("sb")), "b")
    rows = rows.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("sa")), "a").select("a", "b", "sa", "sb")
    verified = written(rows.mapInArrow(verify, "a long, b long, linked boolean"), "ngram-links")
    return verified.unionByName(tried.where("not open").select("a", "b", F.lit(False).alias("linked")))


def _once(pairs: DataFrame, judged: DataFrame | None) -> DataFrame:
    """Pairs (a, b, pa, pb) in order a < b, once each at their first common shingle, without those judged before."""
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("pa"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("pb")
    )
    pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("pa", "pb")).alias("p")).select("a", "b", "p.pa", "p.pb")
    return pairs if judged is None else pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti")


def _starred(lists: DataFrame, percent: int) -> DataFrame:
    """The pairs of each list's classes with their pivot that length and position allow."""
    pairs = lists.select(
        F.col("pivot.cid").alias("a"), F.col("pivot.n").alias("na"), F.col("pivot.pos").alias("pa"),
        F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"),
    ).where("a <> b")
    return pairs.where(_possible("na", "pa", "nb", "pb", percent)).select("a", "b", "pa", "pb")


def _placed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """lists with each class's component so far."""
    return lists.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def _chunked(rest: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs of rest's lists (token, cid, n, pos, comp) across components that all filters allow, worked out in tasks.

    A list of more than CHUNK classes is cut, in order of size, into chunks; a row is one chunk, which meets itself, or two of
    a list, never a pair of classes. What the filter needs of a class goes to its lists, and is written for cut lists alone.
    """
    every = Window.partitionBy("token")
    place = F.row_number().over(every.orderBy("n", "cid")) - 1
    rest = rest.withColumn("chunk", F.floor(place / CHUNK)).withColumn("held", F.count("*").over(every))
    rest = rest.withColumn("lo", F.min("comp").over(every)).withColumn("hi", F.max("comp").over(every)).where("lo <> hi")
    rest = written(rest.drop("lo", "hi"), "ngram-rest")

    def filled(some: DataFrame, *keys: str) -> DataFrame:
        some = some.join(info.select("cid", "hist", "before"), "cid")
        gone = F.transform(F.filter("before", lambda at: at < F.shiftleft(F.col("pos") + 1, 9)), lambda at: at.bitwiseAND(_RANGES - 1).cast("short"))
        row = F.struct("cid", "n", "pos", "comp", "hist", gone.alias("gone"))
        some = some.select(*keys, row.alias("row"))
        return some.groupBy(*keys).agg(F.collect_list("row").alias("x"), *(f(f"row.{c}").alias(k) for k, f, c in (("lo", F.min, "n"), ("hi", F.max, "n"), ("c0", F.min, "comp"), ("c1", F.max, "comp"))))

    whole = filled(rest.where(F.col("held") <= CHUNK), "token")
    chunks = written(filled(rest.where(F.col("held") > CHUNK), "token", "chunk"), "ngram-chunks")
    alone = lambda own: own.select("x", F.lit(None).cast(own.schema["x"].dataType).alias("y"))
    later = chunks.select("token", F.col("chunk").alias("chunk_y"), F.col("x").alias("y"), F.col("lo").alias("lo_y"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    apart = F.expr("not (c0 = c1 and d0 = d1 and c0 = d0)")
    two = chunks.join(later, "token").where((F.col("chunk_y") > F.col("chunk")) & (100 * F.col("hi") >= percent * F.col("lo_y")) & apart).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(rows: pa.StructScalar):
            s = rows.values
            get = lambda c: s.field(c).to_numpy(zero_copy_only=False)
            hist = s.field("hist").to_pylist()
            pos = get("pos")
            gone = s.field("gone")
            ends, ranges = gone.offsets.to_numpy(), gone.values.to_numpy()
            behind = np.stack([_behind(h, ranges[a:b]) for h, a, b in zip(hist, ends[:-1], ends[1:], strict=True)])
            behind = behind.astype(np.uint8) if behind.max() < 255 else behind
            return get("cid"), get("n").astype(np.int64), pos.astype(np.int64), get("comp"), behind

        met: set[tuple[int, int]] = set()  # the filters hold at any shingle that two sets share, so a pair is put out once a task
        for batch in batches:
            for k in range(batch.num_rows):
                xc, xn, xp, xo, xb = read(batch.column("x")[k])
                same = not batch.column("y")[k].is_valid
                yc, yn, yp, yo, yb = (xc, xn, xp, xo, xb) if same else read(batch.column("y")[k])
                out = []
                for i in range(len(xc)):
                    need = -(-percent * (xn[i] + yn) // (100 + percent))
                    ahead = np.minimum(xp[i], yp) + 1
                    left = np.minimum(xn[i] - xp[i], yn - yp) - 1
                    ok = (yo != xo[i]) & (100 * np.minimum(xn[i], yn) >= percent * np.maximum(xn[i], yn)) & (ahead + left >= need)
                    if same:
                        ok[: i + 1] = False
                    some = np.flatnonzero(ok)
                    if len(some):
                        most = np.minimum(np.minimum(xb[i], yb[some]).sum(1, dtype=np.int64), left[some]) + ahead[some]
                        for j in some[most >= need[some]].tolist():
                            pair = (x, y) if (x := int(xc[i])) < (y := int(yc[j])) else (y, x)
                            if pair not in met:
                                met.add(pair)
                                out.append((x, y, int(xp[i]), int(yp[j])))
                if len(met) > 100_000:
                    met.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["a", "b", "pa", "pb"])

    return alone(whole).unionByName(alone(chunks.where("c0 <> c1"))).unionByName(two).mapInArrow(run, "a long, b long, pa int, pb int")


@dataclass
class _Prepared:
    """members (doc_id, n, cid), classes (cid, n, rep, copies), prefix lists that two classes or more share, info (cid, n,
    hist, before) of the classes in them, and sets_of(ids): the sets of some classes."""

    members: DataFrame
    classes: DataFrame
    lists: DataFrame
    info: DataFrame
    sets_of: Callable[[DataFrame], DataFrame]


def _prepared(docs: DataFrame, n: int, percent: int) -> _Prepared:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    first = _first_pass(rows, n)
    members = first.where("part is null").select("doc_id", "n", "cid", "hist")
    classes = written(
        members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("hist").alias("hist")), "ngram-classes"
    )
    rarity = docs.sparkSession.sparkContext.broadcast(_sketch(first))
    lists = _postings(rows, rarity, n, percent).repartition("token")
    lists = lists.groupBy("token", "cid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    lists = lists.withColumn("pivot", F.min(F.struct("cid", "n", "pos")).over(Window.partitionBy("token", "n"))).withColumn("held", F.count("*").over(Window.partitionBy("token")))
    lists = written(lists.where("held > 1"), "ngram-lists")
    place = F.shiftleft("pos", 9).bitwiseOR(F.shiftrightunsigned("token", 55).cast("int"))
    before = lists.groupBy("cid").agg(F.array_sort(F.collect_list(place)).alias("before"))
    info = written(before.join(classes.select("cid", F.col("n").cast("int").alias("n"), "hist"), "cid"), "ngram-info")
    return _Prepared(members.drop("hist"), classes.drop("hist"), lists, info, lambda ids: _sets(rows, classes, ids, n))


def _components(p: _Prepared, percent: int) -> DataFrame:
    """node, component of the classes that link with another."""
    lists, info = p.lists, p.info
    every = Window.partitionBy("token")
    judged = _judged(_once(_starred(lists, percent), None), info, p.sets_of, percent)

    placed = _placed(lists.drop("pivot"), components(judged.where("linked"))).withColumn("crowd", F.count("*").over(Window.partitionBy("token", "comp")))
    pivot = F.min(F.struct((-F.col("crowd")).alias("crowd"), "comp", "cid", "n", "pos")).over(every)
    placed = written(placed.withColumn("pivot", pivot).where("comp <> pivot.comp"), "ngram-placed")
    judged = judged.unionByName(_judged(_once(_starred(placed, percent), judged), info, p.sets_of, percent))

    # What is still open: lists that touch several components, without their pivot, which has met all outside its own.
    rest = _placed(lists.where("held > 2").drop("pivot"), components(judged.where("linked")))
    met = placed.select("token", F.col("pivot.cid").alias("cid")).distinct()
    rest = rest.withColumn("lo", F.min("comp").over(every)).withColumn("hi", F.max("comp").over(every)).where("lo <> hi").join(met, ["token", "cid"], "left_anti")
    across = _once(_chunked(rest.select("token", "cid", "n", "pos", "comp"), info, percent), judged)
    return components(judged.unionByName(_judged(across, info, p.sets_of, percent)).where("linked"))


def _named(members: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, cid of members."""
    rooted = classes.select("cid", "rep").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    rooted = rooted.withColumn("component", F.coalesce("component", "cid"))
    roots = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = rooted.join(roots, "component").select("cid", "component_id")
    return members.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "cid")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many items each set of x shares with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    ox, oy = (np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (x, y))
    fx, fy = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(fx, fy)
    kx, ky = (np.searchsorted(both, f) for f in (fx, fy))
    hx, hy = (np.flatnonzero(both[np.minimum(k, len(both) - 1)] == f) if len(both) else np.empty(0, np.int64) for k, f in ((kx, fx), (ky, fy)))
    ox, kx, oy, ky = ox[hx], kx[hx], oy[hy], ky[hy]
    step = 1 << 12
    sx, sy = np.argsort(kx, kind="stable"), np.argsort(ky, kind="stable")
    ox, kx, oy, ky = ox[sx], kx[sx], oy[sy], ky[sy]
    for a in range(0, len(both), step):  # a bounded slice of shingles at a time
        parts = []
        for o, k, n in ((ox, kx, len(x)), (oy, ky, len(y))):
            lo, hi = np.searchsorted(k, (a, a + step))
            m = np.zeros((n, min(step, len(both) - a)), np.float32)
            m[o[lo:hi], k[lo:hi] - a] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _block_pairs(p: _Prepared, comps: DataFrame, percent: int) -> DataFrame:
    """x, y: two blocks of one component's classes (cid, copies, items) whose sizes allow links; x and y may be one block."""
    keys = comps.withColumnRenamed("node", "cid").join(p.classes.select("cid", "copies", "n"), "cid")
    within = Window.partitionBy("component").orderBy("n", "cid")
    cut = F.floor((F.row_number().over(within) - 1) / BLOCK_SETS) + F.floor((F.sum("n").over(within) - F.col("n")) / BLOCK_SHINGLES)
    keys = written(keys.select("component", "cid", "copies", "n", cut.alias("k")), "ngram-keys")
    last = keys.groupBy("component").agg(F.max("k").alias("last"))
    rows = keys.join(p.sets_of(keys.select("cid")), "cid").join(last, "component")
    blocks = rows.groupBy("component", "k").agg(F.collect_list(F.struct("cid", "copies", "items")).alias("x"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("last").alias("last"))
    blocks = written(blocks, "ngram-blocks")
    # Most components are one block, which meets itself where it is.
    own = blocks.select("x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"), F.lit(True).alias("same"))
    some = blocks.where("last > 0")
    later = some.select("component", F.col("k").alias("l"), F.col("x").alias("y"), F.col("lo").alias("lo_y"))
    two = some.join(later, "component").where((F.col("k") < F.col("l")) & (100 * F.col("hi") >= percent * F.col("lo_y")))
    return own.unionByName(two.select("x", "y", F.lit(False).alias("same")))


def _compared(blocks: DataFrame, percent: int, list_pairs: bool) -> DataFrame:
    """Links inside each pair of blocks: cid, others (rows it links with), or a, b of each link."""

    def read(rows):
        s = rows.values
        return s.field("cid").to_numpy(), s.field("copies").to_numpy(), [np.frombuffer(v, np.uint64) for v in s.field("items").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column("same")[r].as_py()
                xc, xw, x = read(batch.column("x")[r])
                yc, yw, y = (xc, xw, x) if same else read(batch.column("y")[r])
                both = shared_counts(x, y).astype(np.int64)
                sizes = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :]
                linked = 100 * both >= percent * (sizes - both)
                if same:
                    np.fill_diagonal(linked, False)
                if list_pairs:
                    i, j = np.nonzero(np.triu(linked) if same else linked)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(xc[i], yc[j])), pa.array(np.maximum(xc[i], yc[j]))], ["a", "b"])
                else:
                    cid, n = (xc, linked @ yw) if same else (np.concatenate([xc, yc]), np.concatenate([linked @ yw, linked.T @ xw]))
                    yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n)], ["cid", "others"])

    return blocks.mapInArrow(run, "a long, b long" if list_pairs else "cid long, others long")


def _sized(comps: DataFrame) -> DataFrame:
    return comps.join(comps.groupBy("component").agg(F.count("*").alias("size")), "component")


def joined(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links (rows that it links with, copies too)."""
    p = _prepared(docs, n, percent)
    comps = written(_sized(_components(p, percent)), "ngram-comps")
    many = _compared(_block_pairs(p, comps.where("size > 2").select("node", "component"), percent), percent, False)
    # Two classes of a component by themselves are linked.
    two = comps.where("size = 2").select(F.col("node").alias("cid"), "component").join(p.classes.select("cid", "copies"), "cid")
    two = two.join(two.groupBy("component").agg(F.sum("copies").alias("all")), "component").select("cid", (F.col("all") - F.col("copies")).alias("others"))
    others = many.unionByName(two).groupBy("cid").agg(F.sum("others").alias("others"))
    degree = p.classes.select("cid", "copies").join(others, "cid", "left").select("cid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    found = _named(p.members, p.classes, comps.select("node", "component")).join(degree, "cid", "left")
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pairs(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid) of every row of docs, and each link between classes of different sets once: a, b (a < b)."""
    p = _prepared(docs, n, percent)
    return p.members.select("doc_id", "cid"), _compared(_block_pairs(p, _components(p, percent), percent), percent, True)


def linked(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    p = _prepared(docs, n, percent)
    return _named(p.members, p.classes, _components(p, percent)).drop("cid")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is their component's id; of rows that repeat such a doc_id, all; and rows without one."""
    keep = linked(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.where("doc_id is not null").join(keep, "doc_id", "left_semi").select("row.*").unionByName(docs.where("doc_id is null"))


#: Shingle sets, their links and components in SQL.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
c AS (SELECT dense_rank() OVER (ORDER BY list_sort(g)) AS c, doc_id, len(g) AS n, g FROM s),
k AS (SELECT c, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS least, count(*) AS copies FROM c WHERE n > 0 GROUP BY c),
x AS (SELECT c, n, unnest(g) AS t FROM k),
p AS (SELECT x.c AS a, y.c AS b FROM x JOIN x y ON x.t = y.t AND x.c < y.c GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
h AS (SELECT c AS at, c AS root FROM k UNION SELECT e.b, h.root FROM h JOIN e ON e.a = h.at),
m AS (SELECT h.at AS c, min(k.least) AS component_id FROM h JOIN k ON k.c = h.root GROUP BY 1),
o AS (SELECT a AS c, sum(copies) AS others FROM e JOIN k ON k.c = e.b GROUP BY 1)
SELECT c.doc_id, c.n AS n_shingles, coalesce(m.component_id, c.doc_id) AS component_id, CAST(coalesce(k.copies - 1 + coalesce(o.others, 0), 0) AS BIGINT) AS n_links
FROM c LEFT JOIN k USING (c) LEFT JOIN m USING (c) LEFT JOIN o USING (c)
"""


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
