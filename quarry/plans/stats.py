"""Exact table statistics, and the choice between a scan and an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def analyze(df: DataFrame) -> DataFrame:
    """(column, num_rows, num_distinct), null being a value. One aggregate a column, which reads that column alone and
    shuffles its distinct values; in one aggregate for all, every row would be shuffled once a column."""
    out = None
    for c in df.columns:
        value = F.col(f"`{c}`")
        ndv = (F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))).cast("long")
        one = df.select(value).agg(F.count("*").alias("num_rows"), ndv.alias("num_distinct")).select(F.lit(c).alias("column"), "num_rows", "num_distinct")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Path:
    kind: str  # "IndexScan" or "SeqScan"
    cost: float


def access_path(stats: dict | None, column: str | None, indexed: bool) -> Path:
    """A scan costs its rows, an index four times the rows of a value; without statistics an index is taken."""
    if stats is None:
        return Path("IndexScan", 0.0) if indexed and column else Path("SeqScan", float("inf"))
    seq = Path("SeqScan", float(stats["num_rows"]))
    ndv = stats["num_distinct"].get(column) if column else None
    if not indexed or not ndv:
        return seq
    by_index = Path("IndexScan", 4.0 * stats["num_rows"] / ndv)
    return by_index if by_index.cost < seq.cost else seq
