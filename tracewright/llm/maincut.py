"""Main text of web pages: a classifier's costs, adjacency and the DOM in one graph a page, cut by max-flow.

A block of text is a node. Its terminal capacity is what it costs to call it boilerplate, or content: the log odds of a logistic
model over the block's shape (words, share of linked text, sentence end, element) and what the markup around it says. Blocks that
follow each other are tied, the closer in the DOM the stronger; blocks of one element are tied through a node of that element,
and elements through that of their parent. A tie across a border of differently marked parts is weak. The minimum cut is
the cheapest labelling of the page; content is the source's side.

The model is fitted on the blocks that markup labels clearly, counted in cells over a bounded sample of pages (those of the
``SAMPLE_PAGES`` smallest hashes of page_id and url), around fixed prior weights that hold where the sample says nothing.

Defined results: a null or empty html has no text; white space is what Unicode calls so, U+00A0 among it; a page is held by one
task as a whole; repeated pages each get a row; a null page_id or url stays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.dom import GOOD, WEAK, Block, Page, parse
from tracewright.llm.slices import sliced

SAMPLE_PAGES = 2000
SLICE_BYTES = 4 << 20
#: Labelled blocks that the prior weights are worth half as much as.
EVIDENCE = 200.0
LIMIT = 4.0
#: Shape: bias, log of words, share of linked text, ends as a sentence, heading, paragraph, list item.
PRIOR = np.array([-1.5, 0.7, -4.0, 0.8, 0.8, 0.8, -0.3])
FOLLOWS, TIED, BORDER = 1.5, 0.8, 0.1
_SCALE = 1000


def cell(b: Block) -> tuple[int, int, int, int]:
    """A block's shape: log2 of its words, quarters of linked text, sentence end, kind of element."""
    words = min(10, (b.text.count(" ") + 1).bit_length() - 1)
    share = min(4, round(4 * b.linked / len(b.text)))
    kind = 1 if b.tag[0] == "h" and b.tag[1:].isdigit() else 2 if b.tag in ("p", "blockquote", "pre") else 3 if b.tag in ("li", "dt", "dd") else 0
    return words, share, int(b.text.rstrip("\"'»”’)")[-1:] in tuple(".!?…:;。！？")), kind


def features(words: int, share: int, ends: int, kind: int) -> list[float]:
    return [1.0, words * math.log(2), share / 4, float(ends), float(kind == 1), float(kind == 2), float(kind == 3)]


def fitted(cells: list[tuple[tuple[int, int, int, int], int, int]]) -> np.ndarray:
    """Weights from (cell, good, bad) counts: the maximum a posteriori of a logistic model around PRIOR, by Newton steps."""
    w = PRIOR.copy()
    if not cells:
        return w
    x = np.array([features(*c) for c, _, _ in cells])
    good, bad = (np.array([float(c[k]) for c in cells]) for k in (1, 2))
    good, bad = (EVIDENCE / (2 * max(1.0, n.sum())) * n for n in (good, bad))  # each label weighs the same
    for _ in range(20):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (good * (1 - p) - bad * p) - (w - PRIOR) * 2
        step = np.linalg.solve((x * ((good + bad) * p * (1 - p))[:, None]).T @ x + 2 * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def label(b: Block) -> int | None:
    """What markup alone says of a block, where it is clear."""
    return 1 if b.said >= GOOD else 0 if b.said <= WEAK else None


def learn(pages: DataFrame, rows: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from the pages of the smallest hashes. Only counts of cells reach the driver."""
    hashed = pages.select(F.xxhash64("page_id", "url").alias("h"), F.col("html").cast("string").alias("html"))
    last = hashed.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return fitted([])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for batch in batches:
            for x in batch.column(0):
                for b in parse(x.as_py() or "").blocks:
                    if (y := label(b)) is not None:
                        held.setdefault(cell(b), [0, 0])[1 - y] += 1
        rows = [[*c, *n] for c, n in held.items()] or [[0] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], list("abcdgn"))

    counts = hashed.where(F.col("h") <= last).select("html").mapInArrow(count, "a long, b long, c long, d long, g long, n long")
    got = counts.groupBy("a", "b", "c", "d").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).where("g + n > 0").orderBy("a", "b", "c", "d").collect()
    return fitted([((r["a"], r["b"], r["c"], r["d"]), r["g"], r["n"]) for r in got])


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels x of least sum of |gain| over nodes against their gain's sign and of weights over edges with two labels.

    A node whose gain outweighs its open edges is settled, and its edges become gains of its neighbours; what is then left open
    goes to max-flow. Nodes that could go either way are content.
    """
    n = len(gain)
    gain, near, open_sum = gain[:], [[] for _ in range(n)], [0] * n
    for a, b, w in edges:
        if w and a != b:
            near[a].append((b, w))
            near[b].append((a, w))
            open_sum[a] += w
            open_sum[b] += w
    out: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if out[v] is not None or abs(gain[v]) < open_sum[v]:
            continue
        out[v] = gain[v] >= 0
        for u, w in near[v]:
            if out[u] is None:
                gain[u] += w if out[v] else -w
                open_sum[u] -= w
                todo.append(u)
    rest = [v for v in range(n) if out[v] is None]
    if rest:
        for v, x in zip(rest, _max_flow(rest, gain, near, out), strict=True):
            out[v] = x
    return out


def _max_flow(rest: list[int], gain: list[int], near: list, out: list) -> list[bool]:
    """Dinic's algorithm over the open nodes: True where the sink can't be reached in the residual graph."""
    number = {v: k for k, v in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    head: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    room: list[int] = []

    def tie(a: int, b: int, ab: int, ba: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for v in rest:
        if gain[v]:
            tie(s, number[v], gain[v], 0) if gain[v] > 0 else tie(number[v], t, -gain[v], 0)
        for u, w in near[v]:
            if out[u] is None and u > v:
                tie(number[v], number[u], w, w)

    def levels(start: int, back: bool) -> list[int]:
        depth = [-1] * (t + 1)
        depth[start] = 0
        todo = deque([start])
        while todo:
            v = todo.popleft()
            for e in head[v]:
                if room[e ^ 1 if back else e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[v] + 1
                    todo.append(to[e])
        return depth

    while (depth := levels(s, False))[t] >= 0:
        at, path, v = [0] * (t + 1), [], s
        while True:
            if v == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
            elif at[v] < len(head[v]):
                e = head[v][at[v]]
                if room[e] and depth[to[e]] == depth[v] + 1:
                    path.append(e)
                    v = to[e]
                else:
                    at[v] += 1
            elif path:
                v = to[path.pop() ^ 1]
                at[v] += 1
            else:
                break
    sink = levels(t, True)
    return [sink[k] < 0 for k in range(len(rest))]


def graph(page: Page, weights: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Gains and ties of a page's blocks, and of the elements that hold them."""
    whole = lambda x: round(x * _SCALE)
    known: dict[tuple, float] = {}
    gain, edges, place = [], [], {}
    for b in page.blocks:
        c = cell(b)
        if c not in known:
            known[c] = float(np.clip(weights @ features(*c), -LIMIT, LIMIT))
        gain.append(whole(known[c] + b.said))
    blocks = page.blocks
    depth: dict[int, int] = {0: 0}

    def deep(v: int) -> int:
        way = []
        while v not in depth:
            way.append(v)
            v = page.parent[v]
        for u in reversed(way):
            depth[u] = depth[page.parent[u]] + 1
        return depth[way[0] if way else v]

    def apart(a: int, b: int) -> int:
        """Steps between two elements; neighbours in page order share all their way but what was closed and opened between."""
        steps, x, y = 0, deep(a), deep(b)
        while a != b:
            if x >= y:
                a, x, steps = page.parent[a], x - 1, steps + 1
            else:
                b, y, steps = page.parent[b], y - 1, steps + 1
        return steps

    for k in range(len(blocks) - 1):
        a, b = blocks[k].node, blocks[k + 1].node
        weight = FOLLOWS / max(1, apart(a, b) - 1)
        edges.append((k, k + 1, whole(weight * (1 if page.mark[a] == page.mark[b] else BORDER))))
    for k, b in enumerate(blocks):
        v, below = page.parent[b.node] if b.node else 0, k
        mark = page.mark[b.node]
        while True:
            seen = v in place
            if not seen:
                place[v] = len(gain)
                gain.append(0)
            edges.append((below, place[v], whole(TIED * (1 if page.mark[v] == mark else BORDER))))
            if seen or v <= 0:
                break
            below, mark, v = place[v], page.mark[v], page.parent[v]
    return gain, edges


def content(source: str, weights: np.ndarray) -> list[str]:
    """The blocks of a page's main text."""
    page = parse(source)
    if not page.blocks:
        return []
    keep = min_cut(*graph(page, weights))
    return [b.text for b, x in zip(page.blocks, keep, strict=False) if x]


def extracted(pages: DataFrame, rows: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text: blocks of the main text joined by an empty line. One map; no shuffle."""
    weights = learn(pages, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sliced(batch.column("html"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                texts = ["\n\n".join(content(x.as_py() or "", weights)) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string")


#: The given pages name their article in markup; its text, block by block.
SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h[1-6]|div|ul|ol|li|article)>') AS parts FROM pages),
t AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
             regexp_replace(x, '<br/?>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
             '[\s\x{a0}]+', ' ', 'g'))) AS parts FROM a),
j AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""


def op13_main_text(spark, sf_dir: str) -> DataFrame:
    rows = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
