"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample (``SAMPLE_ROWS`` documents picked by a hash of
doc_id), then the rules run in falling order of rejections per second and stop at the first that rejects. The order
changes only the time taken: a document is kept when no rule rejects it, so measured times never change a verdict.

A task holds the features of one text at a time, so its memory does not follow the number of texts in a batch.
``measure`` reports every count, so there the cascade only settles the verdict; ``keep_good`` works out no more than the
rules up to the first that rejects.

Defined results: a null or blank text has no words and fails the base rules; texts may be of any length; repeated rows
each get their own row; an empty table gives an empty table; other columns, whatever their names, are ignored
(``measure``) or passed through (``keep_good``).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


class Text:
    """Lazily measured features of one text, given as UTF-8 bytes."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        solid = self.raw.translate(None, _SPACES)
        return len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
        if len(number) < 1 << 21:
            key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            again = times[which] > 1
        else:
            triples = list(zip(w, w[1:], w[2:], strict=False))
            times_of = Counter(triples)
            again = np.fromiter((times_of[x] > 1 for x in triples), bool, len(triples))
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : len(w) - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def n_shouted(self) -> int:
        return sum(x.decode("utf-8", "replace").isupper() for x in self.words)

    @cached_property
    def n_wordless(self) -> int:
        """Words without a letter."""
        return sum(not x.isalpha() and not any(c.isalpha() for c in x.decode("utf-8", "replace")) for x in self.words)

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip(_SPACES).startswith((b"- ", b"* ", "\u2022 ".encode())) for x in self.lines)

    @cached_property
    def n_trailing_off(self) -> int:
        return sum(x.rstrip(_SPACES).endswith((b"...", "\u2026".encode())) for x in self.lines)

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * n


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("short", lambda t: len(t.words) < MIN_WORDS),
    Rule("repetitive", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * len(t.words)),
    Rule("symbols", lambda t: 20 * t.n_symbols > t.word_chars),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 4 * len(t.lines)),
    Rule("shouting", lambda t: 2 * t.n_shouted > len(t.words)),
    Rule("word_length", lambda t: t.word_chars < 2 * len(t.words) or t.word_chars > 20 * len(t.words)),
    Rule("wordless", lambda t: 10 * t.n_wordless > 4 * len(t.words)),
    Rule("bullets", lambda t: 10 * t.n_bullets > 9 * len(t.lines)),
    Rule("trailing_off", lambda t: 10 * t.n_trailing_off > 3 * len(t.lines)),
)
#: Texts of a batch that are Python objects at once.
_SLICE = 64


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    every = max(1, docs.count() // max(1, rows))
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit("quality-sample")), F.lit(every)) == 0)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) from the sample; measured in tasks, summed to one row a rule."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, out, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for raw in (x for a in range(0, batch.num_rows, _SLICE) for x in batch.column(0).slice(a, _SLICE).to_pylist()):
                n += 1
                for k, rule in enumerate(rules):
                    text = Text(raw)
                    began = time.perf_counter()
                    out[k] += bool(rule.rejects(text))
                    spent[k] += time.perf_counter() - began
        if n:
            yield pa.RecordBatch.from_pydict(
                {"rule": [r.name for r in rules], "seconds": spent, "rejected": out, "n": [n] * len(rules)}
            )

    raw = _sample(docs.select("doc_id", "text"), rows).select(F.col("text").cast("binary").alias("raw"))
    got = (
        raw.mapInArrow(probe, "rule string, seconds double, rejected long, n long")
        .groupBy("rule")
        .agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n"))
        .collect()
    )
    return [(x["rule"], x["s"] / x["n"], x["r"] / x["n"]) for x in got]


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by falling rejections per second; unmeasured rules keep their place at the end."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in estimate(docs, rules, rows)}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def _passes(text: Text, rules: tuple[Rule, ...]) -> bool:
    return not any(rule.rejects(text) for rule in rules)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, base_failed and the cascade's verdict. No shuffle."""
    cascade = ordered(docs, rules, rows)

    def counts(raw: bytes | None) -> tuple:
        t = Text(raw)
        kept = _passes(t, cascade)
        return len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, kept and not t.base_failed

    kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            rows = [counts(x) for a in range(0, batch.num_rows, _SLICE) for x in raw.slice(a, _SLICE).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean",
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    cascade = ordered(docs, rules, rows)

    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            kept = pa.array([_passes(Text(x), cascade) for a in range(0, len(some), _SLICE) for x in some.slice(a, _SLICE).to_pylist()], pa.bool_())
            del some  # a batch is gone before the next one is read
            pa.default_memory_pool().release_unused()
            yield kept

    # Only the text goes to Python; the rows wait in the JVM.
    return docs.where(F.arrow_udf(passes, "boolean")(docs["text"].cast("binary")))


#: The verdict in SQL: the same rules, all of them, over every document.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
        FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM t WHERE len(w) >= 3)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p + k) AS n FROM again, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS shouted,
             len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS wordless
      FROM t LEFT JOIN cov USING (r)),
v AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\n\x0b\x0c\r]*(- |\* |\x{2022} )'))) AS bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t\n\x0b\x0c\r]*$'))) AS trails,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 20 * n_symbols > word_chars OR 10 * n_dup_lines > 4 * len(l) OR 2 * shouted > n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 10 * wordless > 4 * n_words OR 10 * bullets > 9 * len(l) OR 10 * trails > 3 * len(l)) AS kept
FROM v
"""


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
