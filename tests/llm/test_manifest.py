"""The Merkle manifest against plain recursion."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    doc_id, text, lang, source, n = row
    text = text.replace("\n", "") if cut and text is not None else text
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def rise(nodes):
    """The root over nodes, and for each of them the siblings' texts before and after it, level by level."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
    root, above = rise([H(*r) for r in runs])
    return root, [[("".join(runs[k // 3][: k % 3]), "".join(runs[k // 3][k % 3 + 1 :])), *above[k // 3]] for k in range(len(nodes))]


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        mine = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *rise([leaf(r) for r in mine])))
    root, over = rise([t[1] for t in trees])
    out = []
    for (mine, sub, paths), rest in zip(trees, over, strict=True):
        for r, path in zip(mine, paths, strict=True):
            f = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)
            for a, b in path + rest:
                f = H(a, f, b)
            out.append((r[0], leaf(r), sub, root, H(*(a + b for a, b in path + rest)), f, f == root))
    return sorted(map(str, out))


def rows_of(seed, n):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot", "hot", "hot", None, "", "é", "b", "c", f"s{rng.randrange(12)}"])
    text = lambda: rng.choice([None, "", "a\nb", "\n", "ünï\n\n", "x" * 3000, "plain"])
    rows = [(rng.choice([k, k, k, None, -k, 7]), text(), rng.choice(["en", None]), source(), rng.choice([None, k])) for k in range(n)]
    return rows + rows[: n // 8] * 2 + [(1 << 62, "t\n", None, "lone", 1)]


@pytest.mark.parametrize("n", [1, 9, 700])
def test_manifest_is_the_recursion(spark, n):
    rows = rows_of(n, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs = docs.withColumns({c: F.lit("clash") for c in ("tree", "idx", "n", "h", "level", "_row", "_at", "block", "steps", "root")})
    assert sorted(str(tuple(r)) for r in manifest.digest(docs).collect()) == brute(rows)


def test_a_hot_source_over_three_tiers(spark):
    rows = [(k, f"t{k}\n", None, "hot" if k % 3 else f"s{k % 300}", k) for k in range(10_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(tuple(r)) for r in manifest.digest(docs).collect()) == brute(rows)


def test_no_rows(spark):
    assert manifest.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark, agree, tmp_path):
    rows = [r for r in rows_of(5, 200) if r[0] is not None]  # pandas turns ids beside nulls into floats
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert agree(manifest.op11_manifest(spark, str(tmp_path)), manifest.SQL, tmp_path) == len(rows)
