"""Parquet tables of a folder, as DataFrames or views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = tuple("region nation customer supplier part orders lineitem events".split())


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> None:
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
