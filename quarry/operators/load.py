"""Load by partition and key: counts, hot and cold partitions, hot keys, proposals to split and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import salt
from quarry.operators.resolve import latest


def partition_counts(spark: SparkSession, ops: DataFrame, pid: str, n: int, key: str) -> DataFrame:
    """(pid, ops, items) of all n partitions, empty ones included."""
    got = ops.groupBy(pid).agg(F.count("*").alias("ops"), F.count_distinct(key).alias("items"))
    every = spark.range(n).select(F.col("id").cast("int").alias(pid))
    zero = F.lit(0).cast("long")
    return every.join(got, pid, "left").select(pid, F.coalesce("ops", zero).alias("ops"), F.coalesce("items", zero).alias("items"))


def _against_mean(counts: DataFrame) -> DataFrame:
    # counts has one row a partition of the store; its mean is one row
    return counts.withColumn("_mean", F.avg("ops").over(Window.partitionBy(F.lit(0))))


def hot_partitions(counts: DataFrame, threshold: float = 2.0) -> DataFrame:
    return _against_mean(counts).where(F.col("ops") > F.col("_mean") * threshold).drop("_mean")


def cold_partitions(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    return _against_mean(counts).where(F.col("ops") < F.col("_mean") * threshold).drop("_mean")


def split_proposals(counts: DataFrame, threshold: float = 2.0, min_keys: int = 2) -> DataFrame:
    return hot_partitions(counts, threshold).where(F.col("items") >= min_keys)


def merge_proposals(counts: DataFrame, pid: str, threshold: float = 0.5, max_keys: int = 1) -> DataFrame:
    """(left, right): neighbouring cold partitions with few keys each."""
    cold = cold_partitions(counts, threshold).where(F.col("items") <= max_keys).select(pid)
    return cold.select(F.col(pid).alias("left")).join(cold.select(F.col(pid).alias("right")), F.col("left") + 1 == F.col("right"))


def key_frequency(ops: DataFrame, key: str) -> DataFrame:
    return ops.groupBy(key).agg(F.count("*").alias("n"))


def hot_keys(ops: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n most used keys, of equals the smaller ones."""
    return key_frequency(ops, key).orderBy(F.desc("n"), key).limit(n)


def keys_to_salt(ops: DataFrame, key: str, threshold: int) -> DataFrame:
    return key_frequency(ops, key).where(F.col("n") >= threshold)


def salted_latest(ops: DataFrame, key: str, hot: DataFrame, spread: str, buckets: int, order: tuple[str, ...]) -> DataFrame:
    """The last operation of each key, where the operations of hot keys (a column ``key``) are dealt over salted keys.

    The winner of each salted key is found first, then the winner over the buckets of a key.
    """
    marked = ops.join(hot.select(key).distinct().withColumn("_hot", F.lit(True)), key, "left")
    own = F.when(F.col("_hot"), salt(F.col(key), F.col(spread), buckets)).otherwise(F.concat(F.lit("0#"), F.col(key).cast("string")))
    each = latest(marked.withColumn("_salted", own).drop("_hot"), ["_salted"], order, True).drop("_salted")
    return latest(each, [key], order, True)


def rebalanced(partitions: int, nodes: list[str]) -> dict[int, str]:
    """Owners of partitions, as many for each node as for another, give or take one."""
    return {p: nodes[p * len(nodes) // partitions] for p in range(partitions)}


def totals(ops: DataFrame, ts: str, value: str) -> DataFrame:
    """Operations, seconds between the first and the last, operations a second, sum of values."""
    seconds = F.greatest(F.lit(1.0), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6)
    out = ops.agg(F.count("*").alias("ops"), seconds.alias("seconds"), F.sum(value).alias("total"))
    return out.withColumn("throughput", F.col("ops") / F.col("seconds"))
