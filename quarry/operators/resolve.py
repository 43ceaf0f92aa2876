"""From an operation log to the current rows.

An operation has key, ts, origin, seq, is_delete, and in the vector-clock mode vc.
Resolution aggregates by key with partial aggregation before the shuffle, so a key
with very many versions sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.clocks import dominates

ORDER = ("ts", "origin", "seq")


def latest(ops: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER, tombstones: bool = False) -> DataFrame:
    """Last write wins: per key the operation that is greatest by order; deleted keys only if asked for."""
    rest = [c for c in ops.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    out = ops.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))
    return out.select(*ops.columns) if tombstones or "is_delete" not in rest else out.where(~F.col("is_delete")).select(*ops.columns)


def merge_segments(segments: list[DataFrame], keys: list[str], **options) -> DataFrame:
    """The merged rows of several segments, each sorted or not."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return latest(out, keys, **options)


def siblings(ops: DataFrame, keys: list[str], value: str = "value", vc: str = "vc") -> DataFrame:
    """Versions that no other version of their key dominates; equal ones once.

    Versions of equal clocks are first reduced to distinct ones, so a key holds
    as many as it has distinct clocks, which its writers bound, not its writes.
    """
    distinct = ops.withColumn("_c", F.array_sort(F.map_entries(vc))).dropDuplicates([*keys, value, "_c"])
    versions = distinct.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in ops.columns if c not in keys])).alias("_v"))
    kept = F.filter("_v", lambda x: ~F.exists("_v", lambda y: dominates(y[vc], x[vc])))
    return versions.select(*keys, F.inline(kept)).select(*ops.columns)


def winner(ops: DataFrame, keys: list[str], vc: str = "vc", value: str = "value") -> DataFrame:
    """The visible version: an undominated one, of several the latest by order."""
    return latest(siblings(ops, keys, value, vc), keys)


def visible(ops: DataFrame, in_progress: list[str], tx: str | None = None) -> DataFrame:
    """Versions that a reader sees: none created by transactions in progress (but its own), none deleted by finished ones."""
    hidden = [t for t in in_progress if t != tx]
    created = F.col("created_tx").isNull() | ~F.col("created_tx").isin(*hidden) if hidden else F.lit(True)
    deleted = F.col("deleted_tx").isNotNull() & (~F.col("deleted_tx").isin(*hidden) if hidden else F.lit(True))
    return ops.where(created & ~deleted)


def without_duplicates(ops: DataFrame, op_id: Column | str = "op_id") -> DataFrame:
    """Each operation once, however often it was delivered."""
    name = op_id if isinstance(op_id, str) else "_op"
    df = ops if isinstance(op_id, str) else ops.withColumn("_op", op_id)
    return df.dropDuplicates([name]).drop("_op")


def stale_replicas(replicas: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Replicas whose value isn't the winner's: what a read repair rewrites."""
    best = latest(replicas, keys).select(*keys, F.col(value).alias("winner"))
    return replicas.join(best, keys).where(~F.col(value).eqNullSafe(F.col("winner")))
