"""Suffix-array deduplication: common-prefix intervals of an enhanced suffix array, spread over the cluster by anchors.

Every string of ``LENGTH`` bytes has an anchor: the smallest hash among its grams of ``GRAM`` bytes. Equal strings have
equal anchors, so strings that share an anchor can be compared apart from all others. Consecutive strings with the same
anchor are one context (at most ``2 * LENGTH - GRAM`` bytes).

1. Texts are packed into blocks (compressed, written to the shared folder); equal texts of a block are kept once.
2. Blocks send each distinct anchor once to its bucket, and learn which ones other documents hold too.
3. Contexts of shared anchors go to their buckets, each distinct context of a block once with its smallest doc_id. A bucket
   builds the enhanced suffix array of its contexts (sorted suffixes and the lengths of their common prefixes), scans it
   with a stack for the common-prefix intervals of at least LENGTH bytes, and keeps those whose left neighbours differ (or
   where a context begins): the maximal repeats, each with all its occurrences. A repeat that grows to the left in all its
   places is covered by the longer one there, so none is lost. The smallest doc_id of a repeat's places holds it first.
4. Blocks read their marks back, a mark being an occurrence of a maximal repeat with its first holder: bytes of repeats
   first held by a smaller doc_id go.

A passage in a third of all documents is one anchor a block, never one a document, so no bucket holds an unbounded group
of copies; the number of buckets follows the bytes of text.

``maximal_repeats`` lists what repeats: the maximal repeats of whole texts with all their occurrences. Contexts end where
anchors change, so their intervals cannot tell where a longer repeat starts and ends; it compares suffixes of the texts
themselves, from the windows on that follow different bytes. A removed byte is one of a repeat held by a smaller doc_id.

Defined results: a null text is empty; texts under LENGTH bytes stay whole; repeated rows with one doc_id do not remove
each other; rows with a null doc_id count as last and never remove others' bytes; an empty table gives no rows; other
columns are ignored, whatever their names; texts may be of any length.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import written

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SUFFIXES = 300_000
_NULL_ID = (1 << 63) - 1
_A = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BLOCK = "block long, ids binary, which binary, lens binary, nbytes long, body binary"


def _pack(ids: list[int], which: list[int], texts: list[bytes]) -> dict:
    return {
        "block": int.from_bytes(os.urandom(8), "little", signed=True),
        "ids": np.array(ids, np.int64).tobytes(),
        "which": np.array(which, np.int32).tobytes(),
        "lens": np.array([len(t) for t in texts], np.int64).tobytes(),
        "nbytes": sum(map(len, texts)),
        "body": zstandard.ZstdCompressor(level=4).compress(b"".join(texts)),
    }


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("which", pa.binary()), ("lens", pa.binary()), ("nbytes", pa.int64()), ("body", pa.binary())])


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs in packed blocks: ids and the number of its text for each row, lengths and bytes of distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, which, at, size = [], [], {}, 0
        for batch in batches:
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                raw = raw or b""
                if raw not in at:
                    at[raw] = len(at)
                    size += len(raw)
                ids.append(_NULL_ID if i is None else i)
                which.append(at[raw])
                if size >= block_bytes or len(ids) >= 200_000:
                    yield _rows([_pack(ids, which, list(at))], _BLOCK_ARROW)
                    ids, which, at, size = [], [], {}, 0
        if ids:
            yield _rows([_pack(ids, which, list(at))], _BLOCK_ARROW)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return written(raw.mapInArrow(run, _BLOCK), "repeat-blocks")


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of each gram (a power of two bytes)."""
    h, n = _TABLE[b], 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(_A, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if n < w else h


class Block:
    """An unpacked block and its runs: starts of windows with one anchor in one text."""

    def __init__(self, row: dict, length: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.which = np.frombuffer(row["which"], np.int32)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["nbytes"])) if row["nbytes"] else b""
        self.first_id = np.full(len(self.lens), _NULL_ID, np.int64)
        np.minimum.at(self.first_id, self.which, self.ids)
        self._find_runs(length)

    def _find_runs(self, length: int) -> None:
        b, w = np.frombuffer(self.body, np.uint8), length - GRAM + 1
        none = np.empty(0, np.int64)
        self.anchor, self.at, self.windows, self.text = np.empty(0, np.uint64), none, none, none
        if len(b) < length:
            return
        low = _window_minima(gram_hashes(b), w)
        long = np.flatnonzero(self.lens >= length)
        edge = np.zeros(len(low) + 1, np.int8)
        np.add.at(edge, self.starts[long], 1)
        np.add.at(edge, self.ends[long] - length + 1, -1)
        inside = np.cumsum(edge[:-1]).astype(bool)
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[self.starts[long]] = True
        at = np.flatnonzero(inside & new)
        text = np.searchsorted(self.ends, at, side="right")
        stop = np.minimum(np.append(at[1:], len(low)), self.ends[text] - length + 1)
        # A long run (a repetitive text) is cut, which bounds contexts; its parts keep the anchor.
        parts = -(-(stop - at) // w)
        rep = np.repeat(np.arange(len(at)), parts)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.at = at[rep] + k * w
        self.windows = np.minimum(stop[rep] - self.at, w)
        self.text = text[rep]
        self.anchor = low[self.at]

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors by bucket, their buckets, whether two texts here hold them, and each run's place among them."""
        u, which = np.unique(self.anchor, return_inverse=True)
        lo = np.full(len(u), len(self.lens), np.int64)
        hi = np.full(len(u), -1, np.int64)
        np.minimum.at(lo, which, self.text)
        np.maximum.at(hi, which, self.text)
        bucket = (u % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        return u[order], bucket[order], (lo < hi)[order], place[which]

    def contexts(self, shared: np.ndarray, place: np.ndarray, bucket: np.ndarray, length: int):
        """Distinct contexts of runs with shared anchors: (bucket, anchor, first doc, bytes) in order of bucket, and the
        runs with the context each of them has."""
        runs = np.flatnonzero(shared[place]) if len(place) else np.empty(0, np.int64)
        known: dict[bytes, int] = {}
        body = self.body
        ends = self.at[runs] + self.windows[runs] + length - 1
        which = np.fromiter((known.setdefault(body[a:e], len(known)) for a, e in zip(self.at[runs].tolist(), ends.tolist(), strict=True)), np.int64, len(runs))
        first = np.full(len(known), _NULL_ID, np.int64)
        np.minimum.at(first, which, self.first_id[self.text[runs]])
        own = np.zeros(len(known), np.int64)
        own[which] = runs
        b = bucket[place[own]] if len(known) else own
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        texts = list(known)
        return b[order], self.anchor[own][order], first[order], [texts[k] for k in order.tolist()], runs, rank[which]


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    if len(bucket):
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), a, e


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


_ANCHORS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("tags", pa.binary()), ("local", pa.binary())])
_SHARED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
_CONTEXTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("tags", pa.binary()), ("lens", pa.binary()), ("first", pa.binary()), ("body", pa.binary())])
_MARKS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("marks", pa.binary())])
_KINDS = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _tags(anchor: np.ndarray) -> np.ndarray:
    """The half of an anchor that tells anchors of one bucket apart; a clash only brings unrelated contexts together."""
    return (anchor >> np.uint64(32)).astype(np.uint32)


def shared_anchors(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """block, bucket, bits: which of a block's distinct anchors more than one document holds."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, bucket, local, _ = Block(row, length).distinct(buckets)
                tags = _tags(anchors)
                yield _rows(
                    [{"bucket": k, "block": row["block"], "n": e - a, "tags": tags[a:e].tobytes(), "local": _bits(local[a:e])} for k, a, e in _slices(bucket)],
                    _ANCHORS,
                )

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tags = np.concatenate([np.frombuffer(r["tags"], np.uint32) for r in rows])
        local = np.concatenate([np.unpackbits(np.frombuffer(r["local"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        _, which, held = np.unique(tags, return_inverse=True, return_counts=True)
        flags, at, out = local | (held[which] > 1), 0, []
        for r in rows:
            out.append({"block": r["block"], "bucket": r["bucket"], "n": r["n"], "bits": _bits(flags[at : at + r["n"]])})
            at += r["n"]
        return pa.Table.from_pylist(out, _SHARED)

    sent = blocks.mapInArrow(send, _ddl(_ANCHORS))
    return written(sent.groupBy("bucket").applyInArrow(meet, _ddl(_SHARED)), "repeat-shared")


def _flags(rows: list[dict], bucket: np.ndarray) -> np.ndarray:
    by = {r["bucket"]: r for r in rows}
    got = [np.unpackbits(np.frombuffer(by[k]["bits"], np.uint8), count=e - a) for k, a, e in _slices(bucket)]
    return np.concatenate(got).astype(bool) if got else np.empty(0, bool)


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common-prefix intervals of a suffix array: (length, from, to) of each with length >= least, by a stack scan.

    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is 0.
    """
    out: list[tuple[int, int, int]] = []
    high = np.flatnonzero(lcp >= least)
    if len(high):
        cut = np.flatnonzero(np.diff(high) > 1) + 1
        for zone in np.split(high, cut):
            first, values = int(zone[0]) - 1, lcp[zone].tolist()
            stack: list[tuple[int, int]] = []
            for k, v in enumerate([*values, 0]):
                left = first + k
                while stack and stack[-1][0] > v:
                    n, left = stack.pop()
                    out.append((n, left, first + k))
                if v and (not stack or stack[-1][0] < v):
                    stack.append((v, left))
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def left_diverse(left: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the bytes before the suffixes lo..hi differ (or one has none): then the repeat cannot grow to the left."""
    change = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))])
    return (change[hi] > change[lo]) | (left[lo] < 0)


def enhanced(contexts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Enhanced suffix arrays of contexts, in parts of bounded size that no repeat of this length crosses.

    Yields, in order of suffixes: context, offset, common prefix with the suffix before, byte to the left (-1: none).
    """
    size = np.array([len(c) for c in contexts], np.int64)
    wide = int(size.max())
    flat = np.zeros((len(contexts), 2 * wide), np.uint8)
    for k, c in enumerate(contexts):
        flat[k, : len(c)] = np.frombuffer(c, np.uint8)
    n = size - length + 1
    ctx = np.repeat(np.arange(len(contexts)), n)
    off = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
    view = sliding_window_view(flat.reshape(-1), wide)
    zeros = any(b"\0" in c for c in contexts)
    parts = -(-len(ctx) // SUFFIXES)
    if parts > 1:
        head = sliding_window_view(flat.reshape(-1), 8)[ctx * 2 * wide + off + length - 8]
        part = (np.ascontiguousarray(head).view(np.uint64).ravel() * np.uint64(_A) >> np.uint64(40)) % np.uint64(parts)
    for p in range(parts):
        mine = np.flatnonzero(part == p) if parts > 1 else np.arange(len(ctx))
        if not len(mine):
            continue
        rows = view[ctx[mine] * 2 * wide + off[mine]]
        keys, ends = np.ascontiguousarray(rows).view(f"S{wide}").ravel(), size[ctx[mine]] - off[mine]
        if zeros:  # padded keys of a suffix that ends and of one that goes on with zeros are equal: the shorter comes first
            by_end = np.argsort(ends, kind="stable")
            order = by_end[np.argsort(keys[by_end], kind="stable")]
        else:
            order = np.argsort(keys, kind="stable")
        rows, c, o = rows[order], ctx[mine][order], off[mine][order]
        lcp = np.zeros(len(rows), np.int64)
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(1), differ.argmax(1), wide)
        rest = size[c] - o
        lcp[1:] = np.minimum(same, np.minimum(rest[1:], rest[:-1]))
        left = np.where(o > 0, flat[c, np.maximum(o - 1, 0)].astype(np.int16), -1)
        yield c, o, lcp, left


def repeat_marks(contexts: list[bytes], first: np.ndarray, tags: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """context, offset, length, first holder of each occurrence of a maximal repeat that a smaller doc_id holds too."""
    found = []
    _, which, held = np.unique(tags, return_inverse=True, return_counts=True)
    several = np.flatnonzero(held[which] > 1)
    if len(several):
        for c, o, lcp, left in enhanced([contexts[k] for k in several.tolist()], length):
            n, lo, hi = lcp_intervals(lcp, length)
            keep = left_diverse(left, lo, hi) if len(n) else np.empty(0, bool)
            n, lo, hi = n[keep], lo[keep], hi[keep]
            if not len(n):
                continue
            size = hi - lo + 1
            start = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(lo - start, size)
            who = first[several[c[at]]]
            least = np.repeat(np.minimum.reduceat(who, start), size)
            later = who > least
            found.append((several[c[at]][later], o[at][later], np.repeat(n, size)[later], least[later]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _unique_contexts(rows: list[dict]) -> tuple[dict[bytes, int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct contexts of a bucket, each row's contexts as numbers of them, and their first docs and tags."""
    known: dict[bytes, int] = {}
    places, firsts, tags = [], [], []
    for r in rows:
        lens = np.frombuffer(r["lens"], np.uint16).astype(np.int64)
        ends = np.cumsum(lens)
        body = zstandard.ZstdDecompressor().decompress(r["body"], max_output_size=max(1, int(ends[-1])))
        places.append(np.fromiter((known.setdefault(body[e - n : e], len(known)) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)), np.int64, len(lens)))
        firsts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["first"], max_output_size=8 * len(lens)), np.int64))
        tags.append(np.frombuffer(r["tags"], np.uint32))
    first = np.full(len(known), _NULL_ID, np.int64)
    np.minimum.at(first, np.concatenate(places), np.concatenate(firsts))
    tag = np.zeros(len(known), np.uint32)
    tag[np.concatenate(places)] = np.concatenate(tags)
    return known, places, first, tag


_MARK = np.dtype([("ctx", "<u4"), ("lo", "<u2"), ("hi", "<u2"), ("first", "<i8")])


def marks(blocks: DataFrame, shared: DataFrame, buckets: int, length: int) -> DataFrame:
    """block, bucket, marks: for a block's contexts in a bucket, the byte ranges that repeat and who holds them first."""

    def send(block: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            x = Block(row, length)
            _, bucket, _, place = x.distinct(buckets)
            b, anchor, first, texts, _, _ = x.contexts(_flags(bits.to_pylist(), bucket), place, bucket, length)
            tags, press = _tags(anchor), zstandard.ZstdCompressor(level=3)
            for k, a, e in _slices(b):
                out.append(
                    {"bucket": k, "block": row["block"], "n": e - a, "tags": tags[a:e].tobytes(), "lens": np.array([len(t) for t in texts[a:e]], np.uint16).tobytes(),
                     "first": press.compress(first[a:e].tobytes()), "body": press.compress(b"".join(texts[a:e]))}
                )
        return pa.Table.from_pylist(out, _CONTEXTS)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known, places, first, tags = _unique_contexts(rows)
        ctx, off, n, least = repeat_marks(list(known), first, tags, length)
        # A context that is whole in a smaller document too is one more occurrence, of the same context.
        whole = np.array([len(c) for c in known], np.int64)
        ctx, off, n, least = (np.concatenate(x) for x in ((ctx, np.arange(len(known))), (off, np.zeros(len(known), np.int64)), (n, whole), (least, first)))
        order = np.argsort(ctx, kind="stable")
        ctx, off, n, least = ctx[order], off[order], n[order], least[order]
        held = np.bincount(ctx, minlength=len(known))
        begin = np.cumsum(held) - held
        out = []
        for r, place in zip(rows, places, strict=True):
            times = held[place]
            k = np.arange(int(times.sum())) + np.repeat(begin[place] - (np.cumsum(times) - times), times)
            m = np.empty(len(k), _MARK)
            m["ctx"] = np.repeat(np.arange(len(place)), times)
            m["lo"], m["hi"], m["first"] = off[k], off[k] + n[k], least[k]
            out.append({"block": r["block"], "bucket": r["bucket"], "n": r["n"], "marks": zstandard.ZstdCompressor(level=3).compress(m.tobytes())})
        return pa.Table.from_pylist(out, _MARKS)

    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, _ddl(_CONTEXTS))
    return sent.groupBy("bucket").applyInArrow(meet, _ddl(_MARKS))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def deduplicated(docs: DataFrame, length: int = LENGTH, with_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null unless with_text) for every row of docs."""
    blocks = blocks_of(docs, block_bytes)
    total = blocks.agg(F.sum("nbytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    shared = shared_anchors(blocks, buckets, length)
    found = marks(blocks, shared, buckets, length)
    hints = shared.select("block", "bucket", "bits", F.lit(None).cast("binary").alias("marks")).unionByName(
        found.select("block", "bucket", F.lit(None).cast("binary").alias("bits"), "marks")
    )

    def cut(block: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        hints = table.to_pylist()
        for row in block.to_pylist():
            x = Block(row, length)
            _, bucket, _, place = x.distinct(buckets)
            b, _, _, _, runs, which = x.contexts(_flags([h for h in hints if h["bits"] is not None], bucket), place, bucket, length)
            base = {k: a for k, a, _ in _slices(b)}
            got = []
            for h in hints:
                if h["marks"] is not None:
                    m = np.frombuffer(zstandard.ZstdDecompressor().stream_reader(h["marks"]).read(), _MARK)
                    got.append(np.stack([m["ctx"].astype(np.int64) + base[h["bucket"]], m["lo"].astype(np.int64), m["hi"].astype(np.int64), m["first"]], 1))
            gone = np.zeros(len(x.body) + 1, np.int32)
            if got and len(runs):
                m = np.concatenate(got)
                m = m[np.argsort(m[:, 0], kind="stable")]
                n = np.bincount(m[:, 0], minlength=len(b))
                begin = np.cumsum(n) - n
                times = n[which]
                run = np.repeat(runs, times)
                k = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[which], times)
                ok = m[k, 3] < x.first_id[x.text[run]]
                np.add.at(gone, x.at[run[ok]] + m[k[ok], 1], 1)
                np.add.at(gone, x.at[run[ok]] + m[k[ok], 2], -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept_of: dict[int, tuple] = {}
            for i, t in zip(x.ids.tolist(), x.which.tolist(), strict=True):
                n = int(x.lens[t])
                if i > x.first_id[t] and n >= length:  # the whole text stands in a smaller document here
                    removed, spans, kept = n, 1, b""
                else:
                    if t not in kept_of:
                        a = int(x.starts[t])
                        g = gone[a : a + n]
                        spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
                        raw = x.body[a : a + n]
                        kept_of[t] = (int(g.sum()), spans, np.frombuffer(raw, np.uint8)[~g].tobytes() if spans else raw)
                    removed, spans, kept = kept_of[t]
                out.append(
                    {"doc_id": None if i == _NULL_ID else i, "n_bytes": n, "n_removed": removed, "n_spans": spans,
                     "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None}
                )
        return pa.Table.from_pylist(out, _RESULT)

    return blocks.groupBy("block").cogroup(hints.groupBy("block")).applyInArrow(cut, _ddl(_RESULT))


_REPEATS = pa.schema([("repeat", pa.string()), ("n_bytes", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64())])
_PART = 256


def _window_hashes(raw: bytes, length: int) -> np.ndarray:
    n, gram = len(raw) - length + 1, 1 << (length.bit_length() - 1)
    if n <= 0:
        return np.empty(0, np.uint64)
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    return h[:n] * np.uint64(_A) ^ h[length - gram : length - gram + n]


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """h, left, row, at, doc_id of each window of each text; left is the byte before it, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "raw")), strict=True):
                h = _window_hashes(raw, length).view(np.int64)
                n = len(h)
                left = np.concatenate([[-1], np.frombuffer(raw, np.uint8)[: max(0, n - 1)].astype(np.int64)])[:n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(left, pa.int32()), pa.array(np.full(n, row, np.int64)), pa.array(np.arange(n)), pa.array([doc] * n, pa.int64())],
                    ["h", "left", "row", "at", "doc_id"],
                )

    return texts.mapInArrow(run, "h long, left int, row long, at long, doc_id long")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """repeat, n_bytes, row, at, doc_id: every occurrence of every maximal repeat of at least length bytes.

    A repeat stands at two places at least, in one row or several, and grows at neither end without losing a place; the
    ends of a text are unlike all else. repeat tells repeats apart, row numbers the rows of docs, at is a byte offset.
    Suffixes that begin alike are compared part by part, parts twice as long each round, for as long as they agree; the
    places of one window are one group of one task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "repeat-texts")
    windows = _windows(texts, length)
    # Where all places of a window follow one byte, so do those of whatever begins with it.
    starts = windows.groupBy("h").agg(F.count("*").alias("n"), F.min("left").alias("lo"), F.max("left").alias("hi"))
    starts = starts.where("n > 1 and (lo < hi or lo < 0)").select("h")
    front = windows.join(starts, "h", "left_semi").select(F.hex("h").alias("key"), "left", "row", "at", "doc_id")
    front = written(front, "repeat-starts")
    done, part, found = 0, max(_PART, length), None
    while not front.isEmpty():
        least = length if done == 0 else 1

        def split(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["part"])
            lcp = np.array([0, *(_common(a["part"], b["part"]) for a, b in zip(rows, rows[1:], strict=False))], np.int64)
            left = np.array([r["left"] for r in rows], np.int64)
            n, lo, hi = lcp_intervals(lcp, least)
            if done and len(rows) > 1 and not lcp[1:].all():  # the group itself grows no further
                n, lo, hi = np.append(n, 0), np.append(lo, 0), np.append(hi, len(rows) - 1)
            ok = left_diverse(left, lo, hi) if len(n) else np.empty(0, bool)
            out = []
            for k, a, e in zip(n[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), strict=True):
                key = hashlib.sha256(rows[a]["key"].encode() + rows[a]["part"][:k]).hexdigest()
                for r in rows[a : e + 1]:
                    out.append({"key": key, "left": r["left"], "row": r["row"], "at": r["at"], "doc_id": r["doc_id"], "n_bytes": done + k, "open": k == part})
            return pa.Table.from_pylist(out, _SPLIT)

        parts = front.join(texts.select("row", "raw"), "row")
        parts = parts.select("key", "left", "row", "at", "doc_id", F.expr(f"substring(raw, cast(at + {done + 1} as int), {part})").alias("part"))
        got = written(parts.groupBy("key").applyInArrow(split, _SPLIT_DDL), "repeat-round")
        closed = got.where("not open").select(F.col("key").alias("repeat"), "n_bytes", "row", "at", "doc_id")
        found = closed if found is None else found.unionByName(closed)
        front = got.where("open").select("key", "left", "row", "at", "doc_id")
        done, part = done + part, 2 * part
    return docs.sparkSession.createDataFrame([], _ddl(_REPEATS)) if found is None else found


_SPLIT = pa.schema([("key", pa.string()), ("left", pa.int32()), ("row", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("open", pa.bool_())])
_SPLIT_DDL = "key string, left int, row long, at long, doc_id long, n_bytes long, open boolean"


#: Windows of bytes in SQL; hexadecimal digits stand for bytes.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
m AS (SELECT r, p FROM (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM w) WHERE f < doc_id),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m)),
x AS (SELECT r, k, min(p) AS a, max(p) + 50 AS e FROM g GROUP BY r, k),
y AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, list(struct_pack(a := a, e := e) ORDER BY a) AS s FROM x GROUP BY r),
z AS (SELECT doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], list_transform(coalesce(s, []), lambda i: i.e)) AS starts,
             list_concat(list_transform(coalesce(s, []), lambda i: i.a), [len(h) // 2]) AS ends FROM d LEFT JOIN y USING (r))
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda i: substr(h, CAST(2 * starts[i] + 1 AS BIGINT), CAST(2 * (ends[i] - starts[i]) AS BIGINT))), ''))) AS kept_sha256
FROM z
"""


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
