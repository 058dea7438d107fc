"""Arrivals in two phases: stage, score, publish, then a marker; failures kept with their rows; a feed with replay.

A batch's rows, alerts and events lie under its number. What has no marker is in no result, and is written anew when the batch
runs again, so a stop between any two steps loses nothing and publishes nothing twice. A batch that can't be read or scored is
set aside with its files, its reason and, where they could be read, its rows, and the stream goes on.

Keys known from earlier batches are joined, a batch at a time; they are no state of the stream. Rows of one key within a batch
are one row, the least by its columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.streaming.arrivals import run, source

MARKER = "number long, status string, rows long, repeats long, alerts long, last_event long, files array<string>, reason string"
EVENT = "sequence long, kind string, subject string, detail string"
RING = 200
_FILE = "_file"

#: score(new, known): the alerts (subject, detail) that rows new to the case raise beside those already there.
Score = Callable[[DataFrame, DataFrame], DataFrame]


class Inbox:
    """Files of a folder, taken into a case below a folder that all executors share."""

    def __init__(self, spark: SparkSession, inbox: str, at: str, schema: T.StructType, key: str, score: Score, files: int = 1, ring: int = RING):
        self.spark, self.inbox, self.at, self.schema, self.key, self.score, self.files, self.ring = spark, inbox, at, schema, key, score, files, ring

    def _read(self, part: str, schema: T.StructType | str, numbers: list[int] | None = None) -> DataFrame:
        """A part's rows with the number of their batch, of some batches or of all; none before the first is written."""
        typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        typed = T.StructType([*typed.fields, T.StructField("batch", T.LongType())])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{part}")
        if numbers == [] or not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], typed)
        folders = [f"{self.at}/{part}"] if numbers is None else [f"{self.at}/{part}/batch={k}" for k in numbers]
        return self.spark.read.schema(typed).option("basePath", f"{self.at}/{part}").parquet(*folders)

    def _write(self, rows: DataFrame, part: str, number: int) -> DataFrame:
        path = f"{self.at}/{part}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def markers(self) -> DataFrame:
        """One row a batch that is done: status committed or failed."""
        return self._read("markers", MARKER).drop("batch")

    def _done(self, part: str, schema: T.StructType | str, status: str = "committed") -> DataFrame:
        """A part of the batches of one status; the folders of a batch in work are never listed, as it may write them anew."""
        marked = self.markers().where(F.col("status") == status).where(F.lit(part == "staged") | (F.col("status") == "committed"))
        has = marked.where((F.col("status") == "committed") | ~F.col("reason").startswith("read: "))
        return self._read(part, schema, sorted(r["number"] for r in has.select("number").collect()))  # one row a batch

    def rows(self) -> DataFrame:
        """The case: every key that a committed batch brought, once."""
        return self._done("staged", self.schema).drop("batch")

    def alerts(self) -> DataFrame:
        return self._done("alerts", "subject string, detail string")

    def failed(self) -> DataFrame:
        """Rows of failed batches, where they could be read; files and reasons are in markers()."""
        return self._done("staged", self.schema, "failed")

    def feed(self, after: int = 0) -> DataFrame:
        """The newest events behind a sequence number, as far as the ring holds them."""
        last = self.markers().agg(F.coalesce(F.max("last_event"), F.lit(0)).alias("last"))
        rows = self._done("events", EVENT).drop("batch").join(last)  # one row
        return rows.where((F.col("sequence") > after) & (F.col("sequence") > F.col("last") - self.ring)).drop("last").orderBy("sequence")

    def missed(self, after: int = 0) -> int:
        """How many events behind a sequence number the ring no longer holds."""
        last = self.markers().agg(F.max("last_event")).first()[0] or 0
        return max(0, last - self.ring - after)

    def _mark(self, number: int, **said) -> None:
        row = {"number": number, "rows": 0, "repeats": 0, "alerts": 0, "last_event": None, "files": [], "reason": None} | said
        names = T.StructType.fromDDL(MARKER).names
        self._write(self.spark.createDataFrame([tuple(row[n] for n in names)], MARKER).coalesce(1), "markers", number)

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch, from its rows to its marker; nothing if the marker is there."""
        if not self.markers().where(F.col("number") == number).isEmpty():
            return
        step, files = "read", []
        try:
            if _FILE in batch.columns:
                files = sorted(r[0] for r in batch.select(_FILE).distinct().collect())  # the files of one trigger
            known = self.rows()
            all_rows = batch.select(*self.schema.names)
            least = Window.partitionBy(self.key).orderBy(*[F.col(c) for c in self.schema.names])
            once = all_rows.withColumn("_r", F.row_number().over(least)).where("_r = 1").drop("_r")
            new = self._write(once.join(known.select(self.key), self.key, "left_anti").select(*self.schema.names), "staged", number)
            n, came = new.count(), all_rows.count()
            step = "score"
            raised = self._write(self.score(new, known).select(F.col("subject").cast("string").alias("subject"), F.col("detail").cast("string").alias("detail")), "alerts", number)
            alerts = raised.count()
        except (PySparkException, Py4JJavaError) as e:
            reason = str(e)
            self._mark(number, status="failed", files=files or sorted(set(re.findall(r"\w+:/[^\s,]+", reason))), reason=f"{step}: {reason[:500]}")
            return
        last = self.markers().agg(F.coalesce(F.max("last_event"), F.lit(0))).first()[0]
        order = Window.orderBy("subject", "detail")  # the alerts of one batch
        told = raised.select((F.row_number().over(order) + last).cast("long").alias("sequence"), F.lit("alert").alias("kind"), "subject", "detail")
        arrived = self.spark.createDataFrame([(last + alerts + 1, "arrival", str(number), f"{n} new, {came - n} known")], EVENT)
        self._write(told.unionByName(arrived), "events", number)
        self._mark(number, status="committed", rows=n, repeats=came - n, alerts=alerts, last_event=last + alerts + 1, files=files)

    def drain(self) -> Inbox:
        """Take all that has arrived; a restart goes on where the last stop was."""
        stream = source(self.spark, self.inbox, self.schema, self.files)
        run(stream.select("*", F.col("_metadata.file_path").alias(_FILE)), self.take, self.at)
        return self
