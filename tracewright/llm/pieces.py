"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units where no piece of the vocabulary can cross (between a letter and what is no letter, and before
spaces); the rule is read off the piece table, so a text's pieces are its units' pieces. Each distinct unit is encoded
once, in DataFrame operations: explode its substrings up to the longest piece, equi-join them to the piece table, group
the edges by unit, and fold them with a higher-order aggregate. Characters without a piece fall back to byte pieces.

The fold follows the model's kind. A unigram model's pieces carry log probabilities: the fold is the Viterbi recursion,
and the best path has the largest sum. The scores of a model trained by merges are ranks, whose sums mean nothing (the
Viterbi path of the model at hand is the library's encoding for 1 text of 200): there the fold takes the lattice's edges
in order of rank and joins an edge's two parts where both still stand, which is the library's own encoding. It is exact
while no piece is put together from a part that ranks behind it; a test holds the model's whole vocabulary to that, and
the ids to those of the library. Decoding restores every text exactly, spaces included.

Texts are packed into blocks, a block's distinct units once and its texts as numbers of them, and move once. A block asks
for its units; common units are encoded beforehand and broadcast, so that no block asks for them: the ``FREQUENT`` most
common ones of ``SAMPLE_TEXTS`` texts at most, which decides only where a unit is encoded, never its pieces. All others
meet the dictionary in a shuffle join by unit and return to their blocks as numbers and ids.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows each get a row; texts
and units may be of any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 1 << 17
SAMPLE_TEXTS = 20_000
BLOCK_BYTES = 8 << 20
_MISSING = -1e12
_SPACE = "▁"
_FINE = r" *[^\W\d_²³¹]+| *(?:[^\w ]|[\d_²³¹])+| +"
_COARSE = r" *[^ ]+| +"
#: Positions in one word of a unit's boundaries.
_WORD = 60


@dataclass
class Pieces:
    """The model: normal pieces with scores, the id of byte 0, how each id is spelled, the pattern of units."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_base: int
    spelled: list[bytes]
    pattern: str
    by_merges: bool

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Pieces by falling score; pieces of one score share a rank."""
        rank = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        return {p: rank[s] for p, s in self.scores.items()}

    @cached_property
    def id_bits(self) -> int:
        return (len(self.spelled) + 1).bit_length()

    @cached_property
    def none(self) -> int:
        """Stands for the byte pieces of a character without a piece."""
        return (1 << self.id_bits) - 1


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids, scores, spelled, base = {}, {}, [], None
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            b = int(piece[3:5], 16)
            base = i if b == 0 else base
            spelled.append(bytes([b]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            text = piece.replace(_SPACE, " ")
            ids[text], scores[text] = i, model.get_score(i)
            spelled.append(text.encode())
    if base is None or any(spelled[base + b] != bytes([b]) for b in range(256)):
        raise ValueError("the model has no run of byte pieces")
    # Merges are numbered 0, -1, -2, ...; log probabilities are not whole numbers.
    return Pieces(ids, scores, base, spelled, _pattern(ids), all(s == int(s) for s in scores.values()))


def _pattern(pieces) -> str:
    """The finest of three cuts that no piece crosses."""
    for pattern in (_FINE, _COARSE):
        if all(len(re.findall(pattern, p)) == 1 for p in pieces):
            return pattern
    return r"(?s).+"


def units_of(text: str, pattern: re.Pattern) -> list[str]:
    return pattern.findall(" " + text) if text else []


_PACKED = pa.schema(
    [("block", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("which", pa.binary()), ("lens", pa.binary()), ("codes", pa.binary()), ("n_units", pa.int64()), ("units", pa.binary())]
)
_PACKED_DDL = "block long, ids binary, nulls binary, which binary, lens binary, codes binary, n_units long, units binary"


def _press(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=4).compress(raw)


def _unpress(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().stream_reader(raw).read()


class _Block:
    """Rows, distinct texts and distinct units of a block under way."""

    def __init__(self, pattern: re.Pattern):
        self.pattern = pattern
        self.ids: list[int | None] = []
        self.which: list[int] = []
        self.at: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.lens: list[int] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, i: int | None, text: str) -> None:
        k = self.at.get(text)
        if k is None:
            k = self.at[text] = len(self.at)
            number = self.number
            codes = [number.setdefault(u, len(number)) for u in units_of(text, self.pattern)]
            self.codes.append(np.array(codes, np.int64))
            self.lens.append(len(codes))
            self.size += len(text)
        self.ids.append(i)
        self.which.append(k)

    def row(self, block: int) -> pa.RecordBatch:
        """Units are numbered by falling count and then in order, and numbers are cut into planes of bytes, which packs well."""
        codes, units = np.concatenate(self.codes), list(self.number)
        held = np.bincount(codes, minlength=len(units)).tolist()
        order = sorted(range(len(units)), key=lambda k: (-held[k], units[k]))
        rank = np.empty(len(units), "<u4")
        rank[order] = np.arange(len(units), dtype="<u4")
        row = {
            "block": block,
            "ids": np.array([i or 0 for i in self.ids], np.int64).tobytes(),
            "nulls": np.array([i is None for i in self.ids], bool).tobytes(),
            "which": np.array(self.which, np.int32).tobytes(),
            "lens": np.array(self.lens, np.int64).tobytes(),
            "codes": _press(rank[codes].view(np.uint8).reshape(-1, 4).T.tobytes()),
            "n_units": len(units),
            "units": _press("\0".join(units[k].replace("\0", "\0\1") for k in order).encode("utf-8", "surrogatepass")),
        }
        return pa.RecordBatch.from_pylist([row], _PACKED)


def _units(row: dict) -> list[str]:
    if not row["n_units"]:
        return []
    text = _unpress(row["units"]).decode("utf-8", "surrogatepass")
    if "\0\1" not in text:
        return text.split("\0")
    return [u.replace("\0\1", "\0") for u in re.split("\0(?!\1)", text)]


def packed(docs: DataFrame, pieces: Pieces, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks: doc_ids and the text number of each row, distinct texts as numbers of distinct units."""
    pattern_text = pieces.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, number = re.compile(pattern_text), TaskContext.get().partitionId() << 32
        block = _Block(pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    block.add(i, text or "")
                    if block.size >= block_bytes or len(block.ids) >= 200_000:
                        yield block.row(number)
                        number, block = number + 1, _Block(pattern)
        if block.ids:
            yield block.row(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PACKED_DDL).repartition("block")


def common_units(docs: DataFrame, pieces: Pieces, most: int = FREQUENT, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """unit: the most common units of a sample of texts, picked by their hash."""
    pattern_text, every = pieces.pattern, max(1, docs.count() // texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(pattern_text), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(units_of(text, pattern))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["unit", "n"])

    text = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    held = text.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    return held.orderBy(F.col("n").desc(), "unit").limit(most).select("unit")


class _Edge:
    """An edge as one number: rank | end | length | id, so that edges sort by rank, then from left to right."""

    def __init__(self, pieces: Pieces):
        self.id_bits, self.len_bits = pieces.id_bits, pieces.longest.bit_length()
        self.low = self.id_bits + self.len_bits
        self.end_bits = 63 - self.low - self.id_bits

    def pack(self, rank: Column, end: Column, length: Column, id_: Column) -> Column:
        parts = ((rank, self.low + self.end_bits), (end, self.low), (length, self.id_bits), (id_, 0))
        out = F.lit(0).cast("long")
        for value, at in parts:
            out = out.bitwiseOR(_shl(value.cast("long"), at))
        return out

    def end(self, x: Column) -> Column:
        return _shr(x, self.low).bitwiseAND(F.lit((1 << self.end_bits) - 1)).cast("int")

    def length(self, x: Column) -> Column:
        return _shr(x, self.id_bits).bitwiseAND(F.lit((1 << self.len_bits) - 1)).cast("int")

    def start(self, x: Column) -> Column:
        return self.end(x) - self.length(x)

    def key(self, x: Column) -> Column:
        """end | id, to put a path in order."""
        return _shl(self.end(x).cast("long"), self.id_bits).bitwiseOR(x.bitwiseAND(F.lit((1 << self.id_bits) - 1)))


def _shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def _shr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x, n if isinstance(n, Column) else F.lit(n))


def _bit(at: Column) -> Column:
    return _shl(F.lit(1).cast("long"), at)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit (distinct, not empty) -> n, edges: each substring that is a piece, as (x, score); merges need x alone.

    Every character has an edge: of its own piece, or else one for its byte pieces.
    """
    spark, edge = units.sparkSession, _Edge(pieces)
    table = spark.createDataFrame([(p, i, pieces.ranks[p], pieces.scores[p]) for p, i in pieces.ids.items()], "piece string, id int, rank int, score double")
    n = F.char_length("unit")
    spans = units.select("unit", n.alias("n")).select("unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    spans = spans.select("unit", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("n") - F.col("s")))).alias("l"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("l")))
    # The piece table is the vocabulary: its size is fixed by the model.
    found = spans.join(F.broadcast(table), "piece", "left").where("id is not null or l = 1")
    x = edge.pack(F.coalesce("rank", F.lit(0)), F.col("s") + F.col("l"), F.col("l"), F.coalesce("id", F.lit(pieces.none)))
    value = x if pieces.by_merges else F.struct(x.alias("x"), F.coalesce("score", F.lit(_MISSING)).alias("score"))
    return found.select("unit", "n", value.alias("edge")).groupBy("unit").agg(F.first("n").alias("n"), F.collect_list("edge").alias("edges"))


def _by_merges(edge: _Edge) -> Column:
    """The keys of a unit's path: the fold over its edges in order of rank.

    An edge whose ends stand and that has one boundary inside takes it away. Boundaries are the bits of one number, or of
    an array of them where a unit is longer.
    """
    edges, n = F.array_sort("edges"), F.col("n")
    inner = lambda w, x: w.bitwiseAND(_bit(edge.length(x)) - F.lit(2))  # noqa: E731  w: boundaries from an edge's start on
    stands = lambda w, x: (w.bitwiseAND(F.lit(1)) != 0) & (_shr(w, edge.length(x)).bitwiseAND(F.lit(1)) != 0)
    alone = lambda mid: (mid != 0) & (mid.bitwiseAND(mid - F.lit(1)) == 0)
    left = lambda w, x: stands(w, x) & (inner(w, x) == 0)

    def few(m, x):
        w = _shr(m, edge.start(x))
        return F.when(stands(w, x) & alone(inner(w, x)), m.bitwiseXOR(_shl(inner(w, x), edge.start(x)))).otherwise(m)

    short = _once(F.aggregate(edges, _bit(n + 1) - F.lit(1), few), lambda m: F.transform(F.filter("edges", lambda x: left(_shr(m, edge.start(x)), x)), edge.key))

    def window(m, x):
        q, r = (edge.start(x) / _WORD).cast("int"), edge.start(x) % _WORD
        return _shr(F.get(m, q), r).bitwiseOR(_shl(F.coalesce(F.get(m, q + 1), F.lit(0).cast("long")), F.lit(_WORD) - r))

    def many(m, x):
        def cut(w):
            at = edge.start(x) + F.bit_count(inner(w, x) - F.lit(1))
            gone = F.transform(m, lambda v, i: F.when(i == (at / _WORD).cast("int"), v.bitwiseXOR(_bit(at % _WORD))).otherwise(v))
            return F.when(stands(w, x) & alone(inner(w, x)), gone).otherwise(m)

        return _once(window(m, x), cut)

    full = F.transform(F.sequence(F.lit(0), (n / _WORD).cast("int")), lambda i: F.lit((1 << _WORD) - 1).cast("long"))
    long = _once(F.aggregate(edges, full, many), lambda m: F.transform(F.filter("edges", lambda x: left(window(m, x), x)), edge.key))
    return F.array_sort(F.when(n < _WORD, short).otherwise(long))


def _by_scores(edge: _Edge) -> Column:
    """The same for the path with the largest sum of scores: the Viterbi recursion, one end position after another."""
    state = lambda score, s, key: F.struct(score.alias("score"), s.alias("s"), key.alias("key"))

    def best_at(best, e):
        here = F.filter("edges", lambda y: edge.end(y["x"]) == e)
        return F.concat(best, F.array(F.array_max(F.transform(here, lambda y: state(best[edge.start(y["x"])]["score"] + y["score"], edge.start(y["x"]), edge.key(y["x"]))))))

    def back(at, p):
        step = F.struct(at["best"][p]["s"].alias("p"), F.concat(F.array(at["best"][p]["key"]), at["path"]).alias("path"), at["best"].alias("best"))
        return F.when(p == at["p"], step).otherwise(at)

    start = F.array(state(F.lit(0.0), F.lit(0), F.lit(0).cast("long")))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, best_at)
    at = lambda b: F.struct(F.col("n").alias("p"), F.array().cast("array<long>").alias("path"), b.alias("best"))
    return _once(best, lambda b: F.aggregate(F.sequence(F.col("n"), F.lit(1), F.lit(-1)), at(b), back)["path"])


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit (distinct, not empty) -> ids array<int>: the lattice and its fold."""
    edge, none = _Edge(pieces), F.lit(pieces.none)
    path = (_by_merges if pieces.by_merges else _by_scores)(edge)
    id_of = lambda k: k.bitwiseAND(none).cast("int")

    def spelled(k):
        code = F.hex(F.encode(F.substring("unit", _shr(k, edge.id_bits).cast("int"), F.lit(1)), "UTF-8"))
        of_byte = lambda b: F.conv(F.substring(code, 2 * b - 1, F.lit(2)), 16, 10).cast("int") + pieces.byte_base
        return F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), of_byte)

    with_bytes = lambda p: F.flatten(F.transform(p, lambda k: F.when(id_of(k) == none, spelled(k)).otherwise(F.array(id_of(k)))))
    ids = lambda p: F.when(F.exists(p, lambda k: id_of(k) == none), with_bytes(p)).otherwise(F.transform(p, id_of))
    return lattice(units, pieces).select("unit", _once(path, ids).alias("ids"))


def decode(ids: list[int], pieces: Pieces) -> str:
    return b"".join(map(pieces.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


_ANSWER = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary()), ("lens", pa.binary())])
_ANSWER_DDL = "block long, codes binary, ids binary, lens binary"


def _answers(rows: DataFrame) -> DataFrame:
    """(block, code, ids) packed by block within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, code = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "code"))
            ids = batch.column("ids")
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            order = np.lexsort((code, block))
            cut = np.flatnonzero(np.diff(block[order])) + 1
            out = []
            for some in np.split(order, cut):
                lens = (ends[some + 1] - ends[some]).astype(np.int64)
                at = np.arange(int(lens.sum())) + np.repeat(ends[some] - (np.cumsum(lens) - lens), lens)
                out.append({"block": int(block[some[0]]), "codes": _press(code[some].astype(np.int32).tobytes()), "ids": _press(flat[at].astype(np.uint32).tobytes()), "lens": _press(lens.astype(np.uint32).tobytes())})
            yield pa.RecordBatch.from_pylist(out, _ANSWER)

    return rows.select("block", "code", "ids").mapInArrow(run, _ANSWER_DDL)


def encoded(docs: DataFrame, path: str = MODEL, with_ids: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_pieces, ids (array<int>; null unless with_ids), ids_sha256 (little-endian 32-bit), decoded_sha256."""
    spark = docs.sparkSession
    pieces = load(path)
    top = common_units(docs, pieces).repartition("unit")
    known = spark.sparkContext.broadcast({r["unit"]: np.array(r["ids"], np.uint32).tobytes() for r in encode_units(top, pieces).toLocalIterator()})
    spelled = spark.sparkContext.broadcast(pieces.spelled)
    blocks = packed(docs, pieces, block_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).select(["block", "n_units", "units"]).to_pylist()[0]
                some = [(c, u) for c, u in enumerate(_units(row)) if u not in held]
                for a in range(0, len(some), 20_000):
                    part = some[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]] * len(part), pa.int64()), pa.array([c for c, _ in part], pa.int32()), pa.array([u for _, u in part], pa.string())],
                        ["block", "code", "unit"],
                    )
                pa.default_memory_pool().release_unused()

    # Both users of the blocks read all their columns, and both of the questions too, so that either is shuffled once.
    asked = blocks.mapInArrow(ask, "block long, code int, unit string").repartition("unit")
    distinct = asked.groupBy("unit").agg(F.count("block").alias("held"), F.count("code").alias("codes")).where("held > 0 and codes > 0").select("unit")
    answers = _answers(asked.join(encode_units(distinct, pieces), "unit"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(block: pa.Table, table: pa.Table) -> pa.Table:
        parts = []
        for row in block.to_pylist():
            raw: list[bytes | None] = [known.value.get(u) for u in _units(row)]
            for got in table.to_pylist():
                ids, ends = _unpress(got["ids"]), np.cumsum(np.frombuffer(_unpress(got["lens"]), np.uint32).astype(np.int64)) * 4
                for k, a, e in zip(np.frombuffer(_unpress(got["codes"]), np.int32).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    raw[k] = ids[a:e]
            said = [b"".join([spelled.value[i] for i in np.frombuffer(x, np.uint32).tolist()]) for x in raw]
            codes = np.ascontiguousarray(np.frombuffer(_unpress(row["codes"]), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            done, at = [], 0
            for n in np.frombuffer(row["lens"], np.int64).tolist():
                own = codes[at : at + n].tolist()
                at += n
                ids = b"".join([raw[k] for k in own])
                text = b"".join([said[k] for k in own])[1:]
                done.append((len(ids) // 4, np.frombuffer(ids, np.uint32) if with_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
            doc_id, null = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
            which = np.frombuffer(row["which"], np.int32).tolist()
            columns = [[done[t][c] for t in which] for c in range(4)]
            del raw, said, codes
            pa.default_memory_pool().release_unused()
            parts.append(pa.Table.from_arrays([pa.array(doc_id, mask=null), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    found = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return found.applyInArrow(finish, "doc_id long, n_pieces long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
