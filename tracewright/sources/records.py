"""Relay-record ingest: CSV, JSON and XML scans to one canonical frame, validation with reasons, quarantine.

A record that fails is never dropped and never fatal: it goes to the quarantine with every reason it failed for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTS = ("input_addresses", "input_amounts", "output_addresses", "output_amounts")
OPTIONAL = ("tx_version", "locktime", "geo_country", "asn")
#: Canonical name -> type.
FIELDS = {
    "timestamp": "timestamp", "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "txid": "string",
    "input_addresses": "array<string>", "input_amounts": "array<double>", "output_addresses": "array<string>", "output_amounts": "array<double>",
    "fee": "double", "script_type": "string", "geo_country": "string", "asn": "int", "tx_version": "int", "locktime": "bigint",
}
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
_IPV6 = r"^(?=.*:)(?:[0-9A-Fa-f]{1,4}(?::(?!$)|$)|::?(?=[0-9A-Fa-f:])|:){2,8}(?:[0-9A-Fa-f]{0,4})?$|^::$"


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_file", F.input_file_name()).withColumn("row", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; packed lists are split at ';'."""
    rows = spark.read.csv(path, header=True)
    for c in LISTS:
        if c in rows.columns:
            rows = rows.withColumn(c, F.filter(F.transform(F.split(c, ";"), F.trim), lambda x: x != ""))
    return _numbered(rows)


def _raw_schema() -> T.StructType:
    return T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if k in LISTS else T.StringType()) for k in FIELDS])


def read_json(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """An array of records, or the list under one key of a wrapper object."""
    schema = _raw_schema()
    if wrapper is None:
        return _numbered(spark.read.schema(schema).json(path, multiLine=True))
    outer = spark.read.schema(T.StructType([T.StructField(wrapper, T.ArrayType(schema))])).json(path, multiLine=True)
    return _numbered(outer.select(F.explode(wrapper).alias("r")).select("r.*"))


def read_xml(spark: SparkSession, path: str, tag: str = "record") -> DataFrame:
    """One element a record; lists are nested <item> children."""
    item = T.StructType([T.StructField("item", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField(k, item if k in LISTS else T.StringType()) for k in FIELDS])
    rows = spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)
    return _numbered(rows.select(*[F.col(f"{k}.item").alias(k) if k in LISTS else F.col(k) for k in FIELDS]))


READERS = {"csv": read_csv, "json": read_json, "xml": read_xml}


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    kind = fmt or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](spark, path, **options)


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Source columns under their canonical names; absent optional columns become typed nulls."""
    have = {canon: F.col(src) for canon, src in names.items() if src in rows.columns}
    have |= {c: F.col(c) for c in FIELDS if c in rows.columns and c not in have}
    return rows.select("source_file", "row", *[have.get(c, F.lit(None).cast("array<string>" if c in LISTS else "string")).alias(c) for c in FIELDS])


def is_ip(c: Column) -> Column:
    return c.rlike(_IPV4) | c.rlike(_IPV6)


def with_reasons(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """reason: every failed check's text, distinct, joined by '; '; a check that is null fails. Empty for good rows."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for reason, ok in checks]))
    return rows.withColumn("reason", F.array_join(F.array_distinct(failed), "; "))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined)."""
    return rows.where("reason = ''"), rows.where("reason <> ''")


def _numbers(c: str) -> Column:
    return F.transform(c, lambda x: x.try_cast("double"))


def checks() -> list[tuple[str, Column]]:
    c = F.col
    port = lambda p: c(p).try_cast("int").between(0, 65535)
    amounts = lambda a: ~F.exists(_numbers(a), lambda x: x.isNull() | (x < 0))
    return [
        ("bad timestamp", F.try_to_timestamp("timestamp").isNotNull()),
        ("bad IP", is_ip(c("src_ip")) & is_ip(c("dst_ip"))),
        ("port out of range", port("src_port") & port("dst_port")),
        ("empty txid", F.length(F.trim("txid")) >= 1),
        ("no inputs", F.size("input_addresses") >= 1),
        ("no outputs", F.size("output_addresses") >= 1),
        ("mismatched input array lengths", F.size("input_addresses") == F.size("input_amounts")),
        ("mismatched output array lengths", F.size("output_addresses") == F.size("output_amounts")),
        ("negative amount", amounts("input_amounts") & amounts("output_amounts") & (c("fee").try_cast("double") >= 0)),
        ("locktime out of range", c("locktime").isNull() | c("locktime").try_cast("bigint").between(0, 4294967295)),
    ]


def ingest(rows: DataFrame, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed good rows, quarantine of source_file, row, reason, raw)."""
    marked = with_reasons(renamed(rows, names or {}), checks())
    good, bad = split(marked)
    typed = [
        (_numbers(k) if k in ("input_amounts", "output_amounts") else F.try_to_timestamp(k) if t == "timestamp" else F.col(k) if k in LISTS else F.col(k).try_cast(t)).alias(k)
        for k, t in FIELDS.items()
    ]
    raw = F.to_json(F.struct(*FIELDS))
    return good.select("source_file", "row", *typed), bad.select("source_file", "row", "reason", raw.alias("raw"))
