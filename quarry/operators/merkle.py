"""Comparison of data sets by SHA-256 trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def leaf(key: Column, value: Column) -> Column:
    return F.sha2(F.concat(key.cast("string"), F.lit(":"), value.cast("string")).cast("binary"), 256)


def _folded(nodes: Column, levels: Column) -> Column:
    """The node that many levels above an aligned run of nodes; at each level an odd last node pairs with itself."""

    def up(level: Column, _: Column) -> Column:
        n = F.size(level)
        return F.transform(F.sequence(F.lit(0), F.ceil(n / 2).cast("int") - 1), lambda i: F.sha2(F.concat(F.get(level, 2 * i), F.get(level, F.least(2 * i + 1, n - 1))).cast("binary"), 256))

    return F.get(F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), nodes, up)).otherwise(nodes), F.lit(0))


def segment_roots(df: DataFrame, segment: str, key: str, value: str, scratch: str, *, depth: int = 12) -> DataFrame:
    """(segment, root): the root over each segment's leaves in the order of keys; an odd last node pairs with itself.

    Leaves lie in the parts of a range partitioning by segment and key. A part's leaves of a segment are numbered from
    the count of that segment's leaves in the parts before: one row a segment and part tells it, so that a large
    segment is spread over as many tasks as parts. Then each round folds aligned runs of 2 ** depth nodes, dealt by
    run, so a segment of a billion rows takes three rounds. Nodes are kept as 32 bytes; each round is written.
    """
    spark = df.sparkSession
    leaves = df.select(F.col(segment).alias("s"), F.col(key).alias("k"), F.unhex(leaf(F.col(key), F.col(value))).alias("h"))
    leaves = leaves.repartitionByRange("s", "k").sortWithinPartitions("s", "k")
    # the id's low 33 bits number the rows of a partition
    parts = leaves.select("s", "h", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("m"))
    parts.write.mode("overwrite").parquet(f"{scratch}/leaves")
    rows = spark.read.parquet(f"{scratch}/leaves")
    pieces = rows.groupBy(F.col("s").alias("z"), F.col("p").alias("q")).agg(F.min("m").alias("first"), F.count("*").alias("n"))
    pieces = pieces.withColumn("end", F.sum("n").over(Window.partitionBy("z").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)))
    # written, so that the join knows how small it is
    pieces.select("z", "q", "end", (F.col("end") - F.col("n") - F.col("first")).alias("shift")).write.mode("overwrite").parquet(f"{scratch}/pieces")
    pieces = spark.read.parquet(f"{scratch}/pieces")
    most, number = pieces.agg(F.max("end")).first()[0] or 0, 0
    rows = rows.join(pieces, F.col("s").eqNullSafe(F.col("z")) & (F.col("p") == F.col("q"))).select("s", (F.col("m") + F.col("shift")).alias("i"), "h")
    while most > 1:
        runs = rows.groupBy("s", F.shiftright("i", depth).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("l"))
        # a run that isn't the first has others beside it, so it goes all the way up
        levels = F.when(F.col("i") > 0, F.lit(depth)).otherwise(F.least(F.lit(depth), F.ceil(F.log2(F.size("l"))).cast("int")))
        runs = runs.select("s", "i", F.unhex(_folded(F.transform("l", lambda x: F.lower(F.hex(x["h"]))), levels)).alias("h"))
        runs.write.mode("overwrite").parquet(f"{scratch}/round-{number}")
        rows, most, number = spark.read.parquet(f"{scratch}/round-{number}"), -(-most // (1 << depth)), number + 1
    return rows.select(F.col("s").alias(segment), F.lower(F.hex("h")).alias("root"))


def root(spark: SparkSession, df: DataFrame, key: str, value: str, scratch: str, *, depth: int = 12) -> str:
    """The root over all leaves; of nothing, the hash of ""."""
    one = segment_roots(df.withColumn("_all", F.lit(0)), "_all", key, value, scratch, depth=depth).first()
    return one["root"] if one else EMPTY


def differing_keys(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """Local keys whose leaf is missing or different in remote."""
    a = local.select(F.col(key), leaf(F.col(key), F.col(value)).alias("a"))
    b = remote.select(F.col(key), leaf(F.col(key), F.col(value)).alias("b"))
    return a.join(b, key, "left").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)
