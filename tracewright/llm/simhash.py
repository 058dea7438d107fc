"""SimHash fingerprints and block-table search. DataFrame functions only.

Terms are shingles of five words (``[^\\x20\\x09-\\x0D]+``; a shorter text is one term), each occurrence with weight 1, so a
term's weight is how often it stands in the text. The 64 signed votes are summed by a grouped aggregation whose map side
already reduces a document to one row.

Search: fingerprints are cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most ``RADIUS`` bits agree in some
``BLOCKS - RADIUS`` blocks, so one table per choice of blocks, keyed by their bits, finds every such pair; the exact
distance then decides. Equal fingerprints are one row in the tables, so copies cost nothing.

Defined results: null texts are empty, and empty or blank texts have the fingerprint 0; repeated rows are documents of
their own, ordered by text; the document after the last is the first; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
RADIUS = 3
BLOCKS = 5
GROUP = 256
_SPLIT = r"[\x20\x09-\x0D]+"
_LANES = 0x0000000100000001


def terms(text: Column, words: int = WORDS) -> Column:
    """array<long>: a 64-bit hash of each shingle."""
    w = F.transform(F.filter(F.split(text, _SPLIT), lambda x: x != ""), lambda x: F.xxhash64(x))
    n = F.size("_w")
    shingle = lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(words)])
    return w, F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), shingle)).when(
        n > 0, F.array(F.xxhash64(F.col("_w"), n))
    )


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """keys, fp (long) for each distinct combination of keys; every row of one combination must hold the same text."""
    w, shingles = terms(F.col(text), words)
    votes = texts.select(*keys, w.alias("_w")).select(*keys, F.explode_outer(shingles).alias("_h"))
    # Bits k and k + 32 are counted in the two halves of one sum: good for texts up to 2^31 words.
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_LANES))).alias(f"_{k}") for k in range(32)]
    got = votes.groupBy(*keys).agg(F.count("_h").alias("_n"), *sums)
    bit = lambda yes, at: F.shiftleft(F.when(2 * yes > F.col("_n"), F.lit(1)).otherwise(F.lit(0)).cast("long"), at)
    fp = F.lit(0).cast("long")
    for k in range(32):
        fp = fp.bitwiseOR(bit(F.col(f"_{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k))
        fp = fp.bitwiseOR(bit(F.shiftrightunsigned(f"_{k}", 32), k + 32))
    return got.select(*keys, F.when(F.col("_n") > 0, fp).otherwise(F.lit(0).cast("long")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _tables(fps: DataFrame, keep: list[str], radius: int, blocks: int) -> DataFrame:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    rows = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        mask -= (1 << 64) * (mask >= 1 << 63)
        rows.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return fps.select(*keep, F.explode(F.array(*rows)).alias("_b")).select(*keep, "_b.t", "_b.key")


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Every pair (query_fp, fp) of different rows of two tables of distinct column fp at most radius bits apart."""
    q = _tables(queries, ["fp"], radius, blocks).withColumnRenamed("fp", "query_fp")
    b = _tables(fps, ["fp"], radius, blocks)
    near = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))) <= radius
    pairs = q.join(b, ["t", "key"]).where(near)
    return pairs.select("query_fp", "fp").distinct()


def _next_group(ids: DataFrame, levels: tuple[int, ...] = (12, 24)) -> DataFrame:
    """g, next_g for distinct g; the last has null. Windows run over bounded ranges of g, level by level."""
    rest = ids.select("g", F.col("g").alias("lo"))
    found = None
    for shift in (*levels, None):
        part = F.lit(0) if shift is None else F.shiftright("lo", shift)
        w = Window.partitionBy(part).orderBy("lo")
        here = rest.withColumn("next_g", F.lead("lo").over(w))
        if shift is None:
            return here.select("g", "next_g") if found is None else found.unionByName(here.select("g", "next_g"))
        done = here.where("next_g is not null").select("g", "next_g")
        found = done if found is None else found.unionByName(done)
        # The last of each range goes on, in the place of its range; its successor is the first of a later range.
        last = here.where("next_g is null").select("g", part.alias("range"))
        first = rest.groupBy(part.alias("range")).agg(F.min("lo").alias("first"))
        nexts = _next_group(first.select(F.col("range").alias("g")), tuple(s - shift for s in levels if s > shift))
        follow = nexts.join(first.withColumnRenamed("range", "next_g"), "next_g").select(F.col("g").alias("range"), F.col("first").alias("next_g"))
        return found.unionByName(last.join(follow, "range", "left").select("g", "next_g"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, nth, row, text, n_chars, edited, next_id, next_row: texts shuffle once, by ranges of GROUP ids.

    nth is the place of a row in its range, so that equal rows stay apart.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("g", F.coalesce(F.floor(F.col("doc_id") / F.lit(GROUP)), F.lit(-(1 << 55))))
    rows = rows.repartition("g")
    w = Window.partitionBy("g").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ranked = rows.withColumn("next", F.lead(F.struct("doc_id", "text")).over(w)).withColumn("rn", F.row_number().over(w))
    ids = docs.select(F.coalesce(F.floor(F.col("doc_id").cast("long") / F.lit(GROUP)), F.lit(-(1 << 55))).alias("g")).distinct()
    nexts = _next_group(ids)
    first_g = ids.agg(F.min("g")).first()[0]
    nexts = nexts.select("g", F.coalesce("next_g", F.lit(first_g)).alias("next_g"))
    firsts = ranked.where("rn = 1").select(F.col("g").alias("next_g"), F.struct("doc_id", "text").alias("after"))
    after = nexts.join(firsts, "next_g").select("g", "after")
    out = ranked.join(after, "g").withColumn("next", F.coalesce("next", "after"))
    n = F.char_length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    return out.select(
        "doc_id",
        F.col("rn").alias("nth"),
        F.xxhash64("text").alias("row"),
        "text",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
        F.col("next.doc_id").alias("next_id"),
        F.xxhash64("next.text").alias("next_row"),
    )


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and both likenesses."""
    rows = with_edits(docs)
    both = rows.select(
        "doc_id", "nth", "row", "next_id", "next_row", "n_chars",
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"),
    ).select("doc_id", "nth", "row", "next_id", "next_row", "n_chars", "x.kind", "x.text")
    both = both.withColumn("sha", F.when(F.col("kind") == 1, F.sha2(F.col("text").cast("binary"), 256)))
    keys = ["doc_id", "nth", "row", "next_id", "next_row", "n_chars", "kind", "sha"]
    return fingerprints(both, keys)


def digest(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    from tracewright.session import written

    fps = written(compared(docs), "simhash")
    own = fps.where("kind = 0").drop("kind", "sha").withColumnRenamed("fp", "own_fp")
    edited = fps.where("kind = 1").select("doc_id", "nth", "row", "next_id", "next_row", "sha", F.col("fp").alias("edited_fp"))
    after = own.select(F.col("doc_id").alias("n_id"), F.col("row").alias("n_row"), F.col("own_fp").alias("next_fp")).distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    edited = edited.select(*[F.col(c).alias(f"e_{c}") for c in edited.columns])
    rows = own.join(edited, same("doc_id", "e_doc_id") & same("nth", "e_nth") & same("row", "e_row") & same("next_id", "e_next_id") & same("next_row", "e_next_row"))
    rows = rows.join(after, same("next_id", "n_id") & same("next_row", "n_row"), "left")
    held = own.groupBy(F.col("own_fp").alias("fp")).agg(F.count("*").alias("docs"))
    asked = own.where("doc_id % 100 = 0").select(F.col("own_fp").alias("fp")).distinct()
    near = within(asked, held.select("fp"), radius).join(held, "fp").groupBy("query_fp").agg(F.sum("docs").alias("n_near"))
    near = near.withColumnRenamed("query_fp", "own_fp")
    return rows.join(near, "own_fp", "left").select(
        "doc_id",
        "n_chars",
        F.col("e_sha").alias("edited_sha256"),
        hexed(F.col("own_fp")).alias("fingerprint"),
        hexed(F.col("e_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own_fp"), F.col("e_edited_fp")).alias("near_edited"),
        likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.coalesce("n_near", F.lit(0)) - 1).alias("n_near"),
    )


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
