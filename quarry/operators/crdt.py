"""Counters that only grow and sets with observed removal, from rows of replica states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.store import Store


def counter_states(increments: DataFrame, keys: list[str], replica: str, amount: str) -> DataFrame:
    """One state map<replica, total> per key."""
    totals = increments.groupBy(*keys, replica).agg(F.sum(amount).alias("_t"))
    return totals.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(replica, "_t"))).alias("state"))


def merge_counters(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, y), F.coalesce(y, x)))


def counter_value(states: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """The sum of the greatest count known of each replica."""
    each = states.select(*keys, F.explode(state).alias("replica", "n")).groupBy(*keys, "replica").agg(F.max("n").alias("n"))
    return each.groupBy(*keys).agg(F.sum("n").alias("value"))


def set_members(ops: DataFrame, keys: list[str], element: str, tag: str, removes: str) -> DataFrame:
    """Elements with an added tag that no removal names; ``removes`` marks rows that remove a tag."""
    tags = ops.groupBy(*keys, element, tag).agg(F.max(F.col(removes).cast("int")).alias("_r"))
    return tags.where("_r = 0").select(*keys, element).distinct()


def merge_sets(a: Column, b: Column) -> Column:
    """Union of tags of each element; states are map<element, array<tag>>."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))


def set_value(adds: Column, removes: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.map_keys(adds), lambda e: F.size(F.array_except(F.element_at(adds, e), F.coalesce(F.try_element_at(removes, e), none))) > 0)


def apply_increments(store: Store, name: str, column: str, increments: DataFrame) -> None:
    """Add increments (the table's keys, replica, amount) to the counter states map<replica, total> of a table."""
    table = store.catalog.get(name)
    with store.lock:
        new = counter_states(increments, table.keys, "replica", "amount").withColumnRenamed("state", "_new")
        old = store.view(name)
        zero = F.lit(0).cast("long")
        none = F.create_map().cast("map<string,bigint>")
        sums = F.map_zip_with(F.coalesce(F.col(column), none), F.col("_new").cast("map<string,bigint>"), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
        rows = new.join(old, table.keys, "left").select(*(sums.alias(c.name) if c.name == column else F.col(c.name) for c in table.columns))
        store.put(name, rows)
