"""How a transaction was built: its size and ten tells, as plain expressions over one row a transaction.

Frame: ``txs(txid, in_addrs, in_vals, out_addrs, out_vals, fee, version, locktime, sequences, outpoints)``; amounts in coins,
arrays in the transaction's order; fields a source does not carry are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import DEFAULT
from tracewright.operators.ledger import equal_group, script_type

TELLS = ("version", "locktime", "sequence", "ordering", "change_position", "fee", "script_mix", "change_type", "io_shape", "batching")
#: Only a raw transaction shows these.
CONSTRUCTION = ("version", "locktime", "sequence")
#: Weight units by script type, and limits of the protocol.
IN_WEIGHT = {"p2pkh": 592, "p2sh": 364, "p2wpkh": 272, "p2wsh": 420, "p2tr": 230}
OUT_WEIGHT = {"p2pkh": 136, "p2sh": 128, "p2wpkh": 124, "p2wsh": 172, "p2tr": 172}
BASE_WEIGHT, WITNESS_WEIGHT = 40, 2
WITNESS = ("p2wpkh", "p2wsh", "p2tr", "p2sh")
NO_RBF, RBF_MOST, LOCK_TIMES, COIN = 0xFFFFFFFE, 0xFFFFFFFD, 500_000_000, 100_000_000
SAME = 1e-9


def _weights(types: Column, table: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.aggregate(types, F.lit(0), lambda a, t: a + F.coalesce(F.try_element_at(known, t), F.lit(table["p2wpkh"])))


def virtual_size(in_types: Column, out_types: Column) -> Column:
    """Virtual bytes: a quarter of the weight, rounded up."""
    weight = F.lit(BASE_WEIGHT) + _weights(in_types, IN_WEIGHT) + _weights(out_types, OUT_WEIGHT) + F.when(F.exists(in_types, lambda t: t.isin(*WITNESS)), WITNESS_WEIGHT).otherwise(0)
    return F.ceil(weight / 4)


def _sats(x: Column) -> Column:
    return F.bround(x * COIN).cast("long")


def _is_sorted(keys: Column) -> Column:
    return keys == F.array_sort(keys)


def _outpoint(o: Column) -> Column:
    """Sorts like the bytes of the previous id, then the number: byte order reversed."""
    txid = F.substring_index(o, ":", 1)
    bytes_ = F.array_join(F.reverse(F.regexp_extract_all(F.lower(txid), F.lit("(..)"), F.lit(1))), "")
    return F.struct(F.when(F.length(txid) == 64, bytes_).otherwise(txid), F.coalesce(F.substring_index(o, ":", -1).try_cast("int"), F.lit(0)))


def change_output(t: DataFrame) -> DataFrame:
    """t with change (index or null) and change_by: an input's address again, the one output outside an equal group, or the one of the inputs' type."""
    n = F.size("out_addrs")
    at = F.sequence(F.lit(0), n - 1)
    reused = F.filter(at, lambda i: F.array_contains("in_addrs", F.get("out_addrs", i)))
    group = equal_group(F.col("out_vals"), SAME)
    apart = F.filter(at, lambda i: F.abs(F.get("out_vals", i) - group["value"]) > SAME * F.greatest(group["value"], F.lit(1e-12)))
    one_type = (F.size(F.array_distinct("in_types")) == 1) & (F.get("in_types", F.lit(0)) != "")
    same = F.filter(at, lambda i: F.get("out_types", i) == F.get("in_types", F.lit(0)))
    how = (
        F.when(n < 2, None).when(F.size(reused) == 1, "reuse").when((group["n"] >= 3) & (n - group["n"] == 1), "structure").when(one_type & (F.size(same) == 1), "type")
    )
    rows = t.withColumn("change_by", how)
    index = F.when(F.col("change_by") == "reuse", F.get(reused, F.lit(0))).when(F.col("change_by") == "structure", F.get(apart, F.lit(0))).when(F.col("change_by") == "type", F.get(same, F.lit(0)))
    return rows.withColumn("change", index)


def tells(txs: DataFrame, record_type: Column | None = None) -> DataFrame:
    """txid and the ten tells, each a category or null where it cannot be told. record_type: an input's type where its address shows none."""
    fallback = F.lit("") if record_type is None else F.coalesce(record_type, F.lit(""))
    kind = lambda a: F.coalesce(F.nullif(script_type(a), F.lit("")), fallback)
    t = txs.withColumns({"in_types": F.transform("in_addrs", kind), "out_types": F.transform("out_addrs", script_type)})
    t = change_output(t)
    n_out, n_in = F.size("out_addrs"), F.size("in_addrs")
    sequence = F.array_distinct(F.transform("sequences", lambda s: F.when(s <= RBF_MOST, "rbf").when(s == NO_RBF, "locktime_only").otherwise("final")))
    outs = F.zip_with("out_vals", "out_addrs", lambda v, a: F.struct(_sats(v), a))
    outs_told = (n_out >= 2) & (F.size(F.array_distinct("out_vals")) >= 2)
    ins_told = F.coalesce(F.size("outpoints") >= 2, F.lit(False))
    in_order = (~outs_told | _is_sorted(outs)) & (~ins_told | F.coalesce(_is_sorted(F.transform("outpoints", _outpoint)), F.lit(True)))
    sats = _sats(F.col("fee"))
    rate = sats / virtual_size(F.col("in_types"), F.col("out_types"))
    near = lambda step: F.abs(rate / step - F.bround(rate / step)) * step <= 0.01
    types = F.array_distinct(F.filter("in_types", lambda x: x != ""))
    bucket = lambda n, edges: F.coalesce(*[F.when(n <= most, name) for name, most in edges])
    change = F.col("change")
    return t.select(
        "txid",
        F.when(F.col("version") == 1, "v1").when(F.col("version") == 2, "v2").when(F.col("version").isNotNull(), "other").alias("version"),
        F.when(F.col("locktime") == 0, "zero").when(F.col("locktime") < LOCK_TIMES, "height").when(F.col("locktime").isNotNull(), "time").alias("locktime"),
        F.when(F.size(sequence) == 1, sequence[0]).when(F.size(sequence) > 1, "mixed").alias("sequence"),
        F.when(outs_told | ins_told, F.when(in_order, "bip69").otherwise("not_bip69")).alias("ordering"),
        F.when(change == 0, "first").when(change == n_out - 1, "last").when(change.isNotNull(), "middle").alias("change_position"),
        F.when(F.col("fee") > 0, F.when(sats % 10_000 == 0, "round_btc").when((rate >= 5) & near(5), "round_rate").when(near(1), "integer_rate").otherwise("fractional_rate")).alias("fee"),
        F.when(F.size(types) == 1, types[0]).when(F.size(types) > 1, "mixed").alias("script_mix"),
        F.when(F.col("change_by") == "reuse", "reuse_input").when(F.array_contains("in_types", F.get("out_types", change)), "same_type").when(change.isNotNull(), "other_type").alias("change_type"),
        F.concat(bucket(n_in, (("1", 1), ("2-3", 3), ("4+", 10**9))), F.lit("x"), bucket(n_out, (("1", 1), ("2", 2), ("3-5", 5), ("6+", 10**9)))).alias("io_shape"),
        F.when(equal_group(F.col("out_vals"), SAME)["n"] >= 3, "equal_group").when(n_out >= 5, "many_outputs").otherwise("simple").alias("batching"),
    )


def condition(rows: DataFrame) -> Column:
    return F.when(F.coalesce(*CONSTRUCTION).isNotNull(), "full").otherwise("structural")


def structural(rows: DataFrame) -> DataFrame:
    """rows as a source without construction fields would show them."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in CONSTRUCTION})


def corroborated(merges: DataFrame, spends: DataFrame, labels: DataFrame, doubt: float = 0.5) -> DataFrame:
    """cluster, merges, doubtful, confidence: a merge of two wallets whose spends carry different labels counts half; a cluster is as sure as its least merge.

    merges: cluster, a, b (wallets). spends: wallet, txid. labels: txid, label (confident ones).
    """
    own = spends.join(labels, "txid").select("wallet", "label").distinct()
    sides = merges.select("cluster", "a", "b", F.explode(F.array("a", "b")).alias("wallet")).join(own, "wallet", "left")
    per = sides.groupBy("cluster", "a", "b").agg(F.countDistinct("label").alias("labels"))
    sure = F.when(F.col("labels") > 1, doubt).otherwise(1.0)
    return per.groupBy("cluster").agg(F.count("*").alias("merges"), F.sum((F.col("labels") > 1).cast("long")).alias("doubtful"), F.min(sure).alias("confidence"))


def collapsed(members: DataFrame, most: int = DEFAULT.cluster_guard) -> DataFrame:
    """component, wallets: clusters too large to be one owner."""
    return members.groupBy("component").agg(F.count("*").alias("wallets")).where(F.col("wallets") > most)


def defining(rows: DataFrame, label: str = "label", least: float = 0.8) -> DataFrame:
    """label, tell, value: the values that at least this share of a label's transactions with the tell carries. n: how many a row stands for."""
    times = F.col("n") if "n" in rows.columns else F.lit(1)
    long = rows.select(F.col(label).alias("label"), times.alias("n"), F.explode(F.array(*[F.struct(F.lit(t).alias("tell"), F.col(t).alias("value")) for t in TELLS])).alias("x")).select("label", "n", "x.tell", "x.value").where("value is not null")
    held = long.groupBy("label", "tell", "value").agg(F.sum("n").alias("k"))
    share = F.col("k") / F.sum("k").over(Window.partitionBy("label", "tell"))
    return held.withColumn("share", share).where(F.col("share") >= least).select("label", "tell", "value", "share")
