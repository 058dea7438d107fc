"""What is known of addresses and hosts: network ranges, node and Tor lists, watchlists, tag files, seals and the custody ledger.

Files are read and written by Spark, so any folder that it knows will do.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAG = "address string, label string, category string, confidence double, applies_to string, source string, collected string"
#: The kinds of a tag, and what each weighs as a risk.
RISK = {"exchange/VASP": 0.0, "sanctioned": 1.0, "ransomware": 1.0, "darknet market": 1.0, "scam": 1.0, "mixer": 0.5, "other": 0.5}


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for all else."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))


def located(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """ips (column ip) with asn and country of the range (lo, hi, asn, country; numbers, not overlapping) that holds them.

    An as-of join: both sides are dealt out by the address's upper half, ranges being cut there, and a window carries the
    last range's start forward. No pair of a range and an address it does not hold is made.
    """
    cut = ranges.select("lo", "hi", "asn", "country", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("net"))
    cut = cut.select("net", F.greatest("lo", F.shiftleft("net", 16)).alias("at"), F.struct("hi", "asn", "country").alias("r"), F.lit(None).cast("string").alias("ip"))
    one = ips.select("ip").distinct().withColumn("at", ip_number(F.col("ip")))
    asked = one.select(F.coalesce(F.shiftright("at", 16), F.lit(-1)).alias("net"), "at", F.lit(None).cast(cut.schema["r"].dataType).alias("r"), "ip")
    w = Window.partitionBy("net").orderBy(F.col("at").asc_nulls_first(), F.col("r").isNull())
    found = cut.unionByName(asked).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("ip is not null")
    inside = F.col("at") <= F.col("r.hi")
    return found.select("ip", F.when(inside, F.col("r.asn")).alias("asn"), F.when(inside, F.col("r.country")).alias("country"))


def node_list(spark: SparkSession, path: str) -> DataFrame:
    """ip of the nodes of a JSON object keyed host:port."""
    text = spark.read.text(path, wholetext=True)
    keys = F.explode(F.json_object_keys("value"))
    return text.select(keys.alias("k")).select(F.translate(F.regexp_replace("k", r":\d+$", ""), "[]", "").alias("ip")).distinct()


def host_list(spark: SparkSession, path: str) -> DataFrame:
    """ip of each line that is no comment."""
    return spark.read.text(path).select(F.trim("value").alias("ip")).where("ip <> '' and not startswith(ip, '#')").distinct()


def watchlist(spark: SparkSession, *folders: str) -> DataFrame:
    """addr, weight of the first folder that holds a watchlist.json: an object of addresses to weights."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/watchlist.json")
        if p.getFileSystem(conf).exists(p):
            entries = F.explode(F.map_entries(F.from_json("value", "map<string,double>"))).alias("e")
            return spark.read.text(str(p), wholetext=True).select(entries).select(F.col("e.key").alias("addr"), F.col("e.value").alias("weight"))
    return spark.createDataFrame([], "addr string, weight double")


def sanctions(spark: SparkSession, path: str, collected: str) -> DataFrame:
    """Tags of a sanctions list in XML: bitcoin addresses only, persons reduced to their number and programme."""
    ids = "array<struct<idType:string,idNumber:string>>"
    schema = f"uid string, sdnType string, lastName string, programList struct<program:array<string>>, idList struct<id:{ids}>"
    rows = spark.read.format("xml").option("rowTag", "sdnEntry").option("ignoreNamespace", "true").schema(schema).load(path)
    rows = rows.select("*", F.explode("idList.id").alias("i")).where("i.idType = 'Digital Currency Address - XBT'")
    programme = F.array_join("programList.program", ", ")
    label = F.when(F.lower("sdnType") == "individual", F.concat(F.lit("SDN "), "uid", F.lit(" ("), programme, F.lit(")"))).otherwise(F.col("lastName"))
    return rows.select(F.col("i.idNumber").alias("address"), label.alias("label"), F.lit("sanctioned").alias("category"), F.lit(1.0).alias("confidence"), F.lit("address").alias("applies_to"), F.lit("sanctions list").alias("source"), F.lit(collected).alias("collected"))


def tag_file(spark: SparkSession, path: str) -> DataFrame:
    """Tags of a CSV file. One bad row fails the file, and the error names it."""
    need = [c.split()[0] for c in TAG.split(", ")]
    rows = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"columns missing: {missing}")
    sure = F.col("confidence").try_cast("double")
    ok = F.coalesce((F.col("address") != "") & (F.col("label") != "") & F.col("category").isin(*RISK) & sure.between(0, 1) & F.col("applies_to").isin("address", "cluster"), F.lit(False))
    bad = rows.where(~ok).limit(1).collect()
    if bad:
        raise ValueError(f"bad tag: {bad[0].asDict()}")
    return rows.select(*[(sure if c == "confidence" else F.col(c)).alias(c) for c in need])


def seal(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder but manifests, by their names within it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", r"^.*?" + "\\Q" + folder.rstrip("/").rpartition("/")[2] + "\\E/", "")
    rows = files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~F.col("path").rlike(r"(^|/)(manifest\.json|[._].*)$"))


def seal_hash(sealed: DataFrame) -> str:
    """One hash of a seal, whatever the order of its files: over one short line a file."""
    lines = sorted(f"{r['sha256']}  {r['path']}" for r in sealed.select("path", "sha256").toLocalIterator())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def verified(sealed: DataFrame, present: DataFrame) -> DataFrame:
    """path, state: ok, changed, missing or added."""
    both = sealed.select("path", F.col("sha256").alias("was")).join(present.select("path", F.col("sha256").alias("now")), "path", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed").otherwise("ok")
    return both.select("path", state.alias("state"))


def write_bundle(tags: DataFrame, folder: str, name: str, simulated: bool = False) -> None:
    """A sealed folder of tags: JSON lines, what it is, and a manifest with each file's hash and the hash of them all."""
    spark = tags.sparkSession
    tags.write.json(f"{folder}/tags")
    about = spark.createDataFrame([(json.dumps({"name": name, "simulated": simulated, "tags": tags.count()}),)], "value string")
    about.coalesce(1).write.text(f"{folder}/bundle")
    files = seal(spark, folder)
    files.withColumn("manifest", F.lit(seal_hash(files))).write.parquet(f"{folder}.sealed")


def read_bundle(spark: SparkSession, folder: str, real_case: bool = False) -> DataFrame:
    """The tags of a bundle; ValueError if it is altered, not sealed, or simulated in a real case."""
    try:
        sealed = spark.read.parquet(f"{folder}.sealed")
    except Exception as e:
        raise ValueError(f"{folder} is not sealed") from e
    wrong = verified(sealed, seal(spark, folder)).where("state <> 'ok'").limit(5).collect()
    if wrong or sealed.select("manifest").distinct().collect()[0][0] != seal_hash(sealed):
        raise ValueError(f"{folder} was altered: {[tuple(r) for r in wrong]}")
    about = json.loads(spark.read.text(f"{folder}/bundle").first()[0])
    if real_case and about["simulated"]:
        raise ValueError(f"{folder} holds simulated tags")
    return spark.read.schema(TAG).json(f"{folder}/tags").withColumn("bundle", F.lit(about["name"]))


def custody_entry(previous: str, seq: int, action: str, detail: dict, actor: str, at: str) -> dict:
    """The next entry of a hash chain; its hash covers the one before."""
    body = {"seq": seq, "at": at, "actor": actor, "action": action, "detail": json.dumps(detail, sort_keys=True), "previous": previous}
    return body | {"hash": hashlib.sha256("\x1f".join(str(body[k]) for k in ("seq", "at", "actor", "action", "detail", "previous")).encode()).hexdigest()}


def custody_breaks(ledger: DataFrame) -> DataFrame:
    """seq, reason of the entries whose own hash or link to the one before is wrong."""
    own = F.sha2(F.concat_ws("\x1f", F.col("seq").cast("string"), "at", "actor", "action", "detail", "previous"), 256)
    ahead = ledger.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected"))  # a join by number, not one ordered window
    rows = ledger.join(ahead, "seq", "left")
    reason = F.when(F.col("hash") != own, "hash differs").when((F.col("seq") > 1) & ~F.col("previous").eqNullSafe(F.col("expected")), "link broken")
    return rows.select("seq", reason.alias("reason")).where("reason is not null")


def newest_seals(ledger: DataFrame) -> DataFrame:
    """path, sha256 of the latest seal of each path."""
    seals = ledger.where("action = 'seal'").select("seq", F.get_json_object("detail", "$.path").alias("path"), F.get_json_object("detail", "$.sha256").alias("sha256"))
    return seals.groupBy("path").agg(F.max_by("sha256", "seq").alias("sha256"))
