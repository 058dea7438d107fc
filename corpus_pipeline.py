"""The corpus pipeline: quality rules, near duplicates, surrogates for personal data, source mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, ngram_join, pieces, pii, quality
from tracewright.session import written

#: Smaller blocks than the operator's own: its tasks follow those of other stages in the same Python workers.
BLOCK_BYTES = 4 << 20
#: Rows of an Arrow batch at most: a batch of whole texts stands in the JVM's buffers and in a worker at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches hold no more than BATCH_ROWS from here on; results are the same with any size."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null, empty and blank texts are rejected as too short; texts may be of any length; repeated rows fare alike, so all of
    them stay or go; other columns, whatever their names, pass through; an empty table stays empty.
    """
    _small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest id.

    Texts without words link with nothing and stay; rows with a null doc_id stay, as they are nobody's smallest id; rows that
    share the kept doc_id all stay; texts may be of any length; other columns pass through; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by keyed surrogates; n_chars follows the text.

    Null and empty texts stay, a null with its n_chars; texts may be of any length; repeated rows are rewritten alike; other
    columns pass through; an empty table stays empty.
    """
    out = pii.replaced(docs)
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), n).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Texts without words have size 0 and are taken once or not at all, as their source's rate rounds; a null source is one of
    its own; ties are settled by doc_id and seeded draws; rows that share a doc_id share the larger count; other columns pass
    through; an empty table stays empty.
    """
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_sha256 of every row.

    Null and empty texts have no pieces; texts and words may be of any length; repeated rows each get a row; other columns
    are ignored; an empty table gives no rows.
    """
    _small_batches(spark)
    return pieces.encoded(docs, with_ids=False, block_bytes=BLOCK_BYTES).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The mix draws at random and the lattice is a recursion: no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
