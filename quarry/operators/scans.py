"""Reads: ranges over clustering keys, pages with search, segments and their files, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import hash_partition
from quarry.sources.store import Store


def scan_range(df: DataFrame, partition: Column, clustering: str, start, end) -> DataFrame:
    """Rows of one partition key with start <= clustering <= end, in order."""
    return df.where(partition & F.col(clustering).between(start, end)).orderBy(clustering)


def page(df: DataFrame, key: list[str], offset: int = 0, limit: int | None = None, query: str | None = None, search: list[str] | None = None) -> DataFrame:
    """A page of the matching rows in the order of their keys; the query is a substring, whatever its case."""
    if query:
        match = F.lit(False)
        for c in search or key:
            match = match | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
        df = df.where(match)
    df = df.orderBy(*key)
    if limit is not None:
        df = df.limit(offset + limit)  # the top rows only, before the offset is taken
    return df.offset(offset) if offset else df


def segment_summary(df: DataFrame, segment: str | Column, key: str) -> DataFrame:
    """Items, first and last key of each segment."""
    s = F.col(segment) if isinstance(segment, str) else segment
    return df.groupBy(s.alias("segment")).agg(F.count("*").alias("items"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def file_summary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Of each file of a Parquet table: name, size in KB, items, first and last key."""
    df = spark.read.parquet(path).select(F.col(key), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return df.groupBy("file").agg((F.max("bytes") / 1024).alias("kb"), F.count("*").alias("items"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def event_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(time, message) of lines "[YYYY-mm-dd HH:MM:SS] message"."""
    form = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] (.*)$"
    df = lines.where(F.col(column).rlike(form))
    return df.select(F.to_timestamp(F.regexp_extract(column, form, 1)).alias("time"), F.regexp_extract(column, form, 2).alias("message"))


def move_partition(source: Store, target: Store, name: str, pid: int, n: int) -> int:
    """Hand the operations of one of n hash partitions of a table to another store and delete their rows here; their number."""
    with source.lock, target.lock:
        table = source.catalog.get(name)
        ops = source.log(name).where(hash_partition(F.col("key"), n) == pid)
        moved = ops.count()
        if moved:
            target.append(name, ops)
            here = source.resolved(name).where(hash_partition(F.col("key"), n) == pid).select("row.*")
            source.append(name, source.operations(table, here, delete=True))
        return moved
