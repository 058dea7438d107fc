"""Arriving files: a file stream, idempotent batches, each id once, bad files set aside."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import shared_dir


def _folder(path: str) -> tuple[str, dict[str, str]]:
    """A stream reads folders: a single file is its parent with a name filter."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return parent, {"pathGlobFilter": "*.parquet", "recursiveFileLookup": "false"} | ({"pathGlobFilter": name} if name.endswith(".parquet") else {})


def source(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """The stream of a table's files, oldest first, a few at a time. A table is one parquet file or a folder of them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    is_dir = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false")
    if is_dir:
        return reader.parquet(path)
    parent, options = _folder(path)
    return reader.options(**options).parquet(parent)


def run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], at: str) -> None:
    """Drain what has arrived; progress is kept in the shared folder, so a restart goes on where it stopped."""
    stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/batches")


def drained(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """All rows of the stream, each key once: the keys seen are the stream's keyed state, dealt out over the executors.

    A batch is written under its id, so a replay overwrites it with itself.
    """
    at = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"

    def commit(batch: DataFrame, number: int) -> None:
        batch.select(*schema.names).write.mode("overwrite").parquet(f"{at}/batches/{number}")

    run(source(spark, path, schema).dropDuplicates([key]), commit, at)
    return committed(spark, at, schema)


def windowed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Counts and sums by day and type over all arrivals, however late: each batch's partial sums, added up.

    A batch is written under its id, so a replay overwrites it with itself.
    """
    at = f"{shared_dir(spark)}/w{uuid.uuid4().hex}"
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400 * 10**6)).cast("long")

    def put(batch: DataFrame, number: int) -> None:
        by = batch.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        by.write.mode("overwrite").parquet(f"{at}/batches/{number}")

    run(source(spark, path, schema), put, at)
    got = committed(spark, at, T.StructType.fromDDL("day long, event_type string, n long, v double"))
    return got.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 4).alias("v"))


def guarded(on_batch: Callable[[DataFrame, int], None], failed: list[tuple[int, str]]) -> Callable[[DataFrame, int], None]:
    """A batch that fails is recorded and the loop goes on."""

    def safe(batch: DataFrame, number: int) -> None:
        try:
            on_batch(batch, number)
        except Exception as e:  # noqa: BLE001  the reason is kept for the operator
            failed.append((number, str(e)[:500]))

    return safe


def new_alerts(now: DataFrame, before: DataFrame, touched: DataFrame, key: str = "entity") -> DataFrame:
    """Alerts that this arrival raised: not there before, and of entities it touched."""
    return now.join(before.select(key), key, "left_anti").join(touched.select(key), key, "left_semi")
