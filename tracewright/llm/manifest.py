"""A Merkle manifest of a dataset: leaves a row, a ternary tree a source, a tree over the sources' roots, and lookup proofs.

``H`` is the lower-case hex SHA-256 of its inputs, digests as hex text. While a group has several nodes, every ``ARITY``
consecutive ones become their ``H``. Places come from one range sort: a row's place in its source is its place in its range
and the counts of the ranges before, so no source, however large, is one task.

The tree grows in tiers of ``TIER`` levels: ``ARITY ** TIER`` neighbours are one small group, whose nodes go to the node table
(tree, level, idx). A proof is a lookup by coordinates: a leaf's siblings on each level follow from its index and the size of
its group; they are exploded, joined with the node table, put in order, concatenated, and folded. A leaf asks for the levels of
its own tier alone and takes the rest from the node above it, which asked once for all below it. So the upper nodes, which
every proof has in common, are no hot keys.

Defined results: nulls are ``-``; rows of one source and doc_id (null first) are ordered by their leaf, equal rows stand side
by side and each has its own proof; a null source is a source of its own, before the others; a null doc_id is never tampered
with; empty texts are ``0:``; texts may be of any length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import written

ARITY = 3
TIER = 4
PARTS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = [ARITY**k for k in range(TIER + 1)]
_POWER = f"array({', '.join(f'{p}L' for p in _POWERS)})"


def H(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hexed(h: Column) -> Column:
    """A digest as text; tables and shuffles hold its 32 bytes."""
    return F.lower(F.hex(h))


def part(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, h, tampered: a row's leaf, and its leaf after the tampering, where it suffers some."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    parts = [part(F.col(c)) for c in PARTS[:-1]]
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(H(*parts, part(text))).alias("h"),
        F.when(hit & text.contains("\n"), F.unhex(H(*parts, part(F.replace(text, F.lit("\n"), F.lit("")))))).alias("tampered"),
    )


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, their place from 0 in their tree, and n, the tree's size. Equal rows are dealt out as any others."""
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-rows")
    keys = ["tree", *order, "_row"]
    at = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "manifest-order").withColumn("_range", F.shiftright("_at", 33))
    held = at.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # a row for each range that the tree reaches into
    earlier = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("tree", "_range", "_first", F.sum("_n").over(tree).alias("n"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return at.join(held, ["tree", "_range"]).select(*rows.columns, "n", (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"))


def _levels(n: str = "n") -> Column:
    """Levels above the leaves in a tier of a tree with n nodes."""
    out = F.lit(TIER)
    for k in reversed(range(TIER)):
        out = F.when(F.col(n) <= _POWERS[k], F.lit(k)).otherwise(out)
    return out


def nodes_of(rows: DataFrame) -> DataFrame:
    """The node table of one tier over rows (tree, n, idx, h): tree, n, deep, level, idx, h."""
    block = F.expr(f"idx div {_POWERS[TIER]}L")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: hexed(x["h"]))
    out = rows.groupBy("tree", "n", block.alias("block")).agg(ordered.alias("l0")).withColumn("deep", _levels())
    for k in range(TIER):
        up = f"transform(sequence(0, (size(l{k}) - 1) div {ARITY}), r -> sha2(concat_ws('', slice(l{k}, r * {ARITY} + 1, {ARITY})), 256))"
        out = out.withColumn(f"l{k + 1}", F.expr(f"if(deep > {k}, {up}, cast(array() as array<string>))"))
    every = [f"transform(l{k}, (h, i) -> named_struct('level', {k}, 'idx', block * {_POWERS[TIER - k]}L + i, 'h', unhex(h)))" for k in range(TIER + 1)]
    return out.select("tree", "n", "deep", F.explode(F.expr(f"concat({', '.join(every)})")).alias("x")).select("tree", "n", "deep", "x.*")


#: The coordinates of a row's siblings: its run on each level, within the size of that level, without itself.
_SIBLINGS = f"""flatten(transform(slice({_POWER}, 1, deep), (p, l) -> filter(
    transform(sequence(0L, {ARITY - 1}L), k -> named_struct('level', l, 'sibling', idx div p div {ARITY} * {ARITY} + k)),
    s -> s.sibling != idx div p and s.sibling < (n + p - 1) div p)))"""
#: Siblings in order, as the text before and the text after the folded node on each level.
_STEPS = f"""transform(slice({_POWER}, 1, deep), (p, l) -> named_struct(
    'before', concat_ws('', transform(filter(found, s -> s.level = l and s.sibling < idx div p), s -> lower(hex(s.h)))),
    'after', concat_ws('', transform(filter(found, s -> s.level = l and s.sibling > idx div p), s -> lower(hex(s.h))))))"""
_FOUND = "array<struct<level:int,sibling:bigint,h:binary>>"


def _steps(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with steps: what stands before and after the folded node on each level of their tier."""
    rows = rows.withColumn("deep", _levels())
    asked = rows.select("tree", F.col("idx").alias("of"), F.explode(F.expr(_SIBLINGS)).alias("s")).select("tree", "of", "s.*")
    known = nodes.select("tree", "level", F.col("idx").alias("sibling"), "h")
    found = asked.join(known, ["tree", "level", "sibling"]).groupBy("tree", F.col("of").alias("idx"))
    found = found.agg(F.sort_array(F.collect_list(F.struct("level", "sibling", "h"))).alias("found"))
    out = rows.join(found, ["tree", "idx"], "left").withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))
    return out.withColumn("steps", F.expr(_STEPS)).drop("found", "deep")


def proven(rows: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (tree, n, idx, h, ...) with steps, all the way up, and what above adds.

    above(roots): for the trees' roots (tree, h), a table tree, steps, and columns to hand down.
    """
    tiers, roots, here = [], None, rows
    while True:
        nodes = written(nodes_of(here.select("tree", "n", "idx", "h")), "manifest-nodes")
        tiers.append((here, nodes))
        tops = nodes.where("level = deep").select("tree", F.expr(f"(n + {_POWER}[deep] - 1) div {_POWER}[deep]").alias("n"), "idx", "h")
        roots = tops.where("n = 1") if roots is None else roots.unionByName(tops.where("n = 1"))
        here = tops.where("n > 1")
        if here.isEmpty():
            break
    over = above(roots.select("tree", "h"))
    extra = [c for c in over.columns if c not in ("tree", "steps")]
    over = over.withColumnRenamed("steps", "rest").withColumn("block", F.lit(0).cast("long"))
    ended = over
    for k, (mine, nodes) in reversed(list(enumerate(tiers))):
        got = _steps(mine, nodes).withColumn("block", F.expr(f"idx div {_POWERS[TIER]}L"))
        got = got.join(over, ["tree", "block"]).withColumn("steps", F.concat("steps", "rest")).drop("rest", "block")
        if k == 0:
            return got
        lower = got.select("tree", F.col("idx").alias("block"), F.col("steps").alias("rest"), *extra)
        # Trees that ended in the tier below have their root there.
        small = tiers[k - 1][1].where(f"level = deep and n <= {_POWERS[TIER]}").select("tree")
        over = written(lower.unionByName(ended.join(small, "tree", "left_semi").select(lower.columns)), "manifest-paths")
    raise AssertionError


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: H(s["before"], h, s["after"]))


def siblings(steps: Column) -> Column:
    """All sibling digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def _sources(roots: DataFrame) -> DataFrame:
    """tree, steps, subroot, root: the tree over the sources' roots."""
    rows = indexed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h"), ["of"])
    top = lambda r: r.select("tree", F.array().cast("array<struct<before:string,after:string>>").alias("steps"), hexed(F.col("h")).alias("root"))
    return proven(rows, top).select(F.col("of").alias("tree"), "steps", hexed(F.col("h")).alias("subroot"), "root")


def manifest(docs: DataFrame) -> DataFrame:
    """tree, doc_id, h, tampered, steps, subroot, root of every row."""
    return proven(indexed(leaves(docs), ["doc_id", "h"]), lambda roots: written(_sources(roots), "manifest-sources"))


def digest(docs: DataFrame) -> DataFrame:
    rows = manifest(docs).withColumn("folded_root", folded(hexed(F.coalesce("tampered", "h")), F.col("steps")))
    return rows.select(
        "doc_id", hexed(F.col("h")).alias("leaf"), "subroot", "root", H(siblings(F.col("steps"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = """
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
             coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             replace(text, chr(10), '') AS cut FROM documents, bits),
leaf AS (SELECT tree, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
                sha256(head || CASE WHEN crc % 2 = 0 THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS f FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
             row_number() OVER () AS row FROM leaf),
up AS (SELECT tree, 0 AS level, idx, n, h FROM r
       UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 3, (n + 2) // 3),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
over_ AS (SELECT 0 AS level, idx, n, h FROM s
          UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM over_ WHERE n > 1 GROUP BY level, idx // 3, (n + 2) // 3),
runs AS (SELECT tree, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM up WHERE n > 1 GROUP BY ALL
         UNION ALL SELECT '', level, idx // 3, list(h ORDER BY idx) FROM over_ WHERE n > 1 GROUP BY ALL),
low AS (SELECT row, tree, 0 AS level, idx, n, f, '' AS proof FROM r
        UNION ALL SELECT row, low.tree, level + 1, idx // 3, (n + 2) // 3,
                         sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i - 1 = idx % 3 THEN f ELSE x END), '')),
                         proof || array_to_string(list_filter(hs, lambda x, i: i - 1 <> idx % 3), '')
        FROM low JOIN runs USING (tree, level) WHERE n > 1 AND run = idx // 3),
high AS (SELECT row, tree, 0 AS level, s.idx, s.n, f, proof FROM low JOIN s USING (tree) WHERE low.n = 1
         UNION ALL SELECT row, high.tree, level + 1, idx // 3, (n + 2) // 3,
                         sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i - 1 = idx % 3 THEN f ELSE x END), '')),
                         proof || array_to_string(list_filter(hs, lambda x, i: i - 1 <> idx % 3), '')
        FROM high JOIN runs USING (level) WHERE runs.tree = '' AND n > 1 AND run = idx // 3)
SELECT r.doc_id, r.h AS leaf, s.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256,
       high.f AS folded_root, high.f = o.h AS verified
FROM r JOIN s USING (tree) JOIN high USING (row), (SELECT h FROM over_ WHERE n = 1) AS o WHERE high.n = 1
"""


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
