"""Secondary indexes: (value, key) tables built from current rows, and reads through them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.store import Store


def entries(rows: DataFrame, column: str, key: Column) -> DataFrame:
    """The index of a column: one row per row of the table."""
    return rows.select(F.col(column).alias("value"), key.alias("key"))


def keys_by_value(rows: DataFrame, column: str, key: Column) -> DataFrame:
    """(value, n, first_key): how many keys each value has."""
    return entries(rows, column, key).groupBy("value").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def lookup(index: DataFrame, value) -> DataFrame:
    """Distinct keys of a value, in order. The comparison is typed: "5" isn't 5."""
    return index.where(F.col("value") == F.lit(value)).select("key").distinct().orderBy("key")


def through(rows: DataFrame, key: Column, index: DataFrame, value, residual: Column | None = None) -> DataFrame:
    """Rows whose indexed value is value, by way of the index; the rest of the predicate is applied as well."""
    keyed = rows.withColumn("_key", key)
    found = keyed.join(index.where(F.col("value") == F.lit(value)).select(F.col("key").alias("_key")), "_key", "left_semi").drop("_key")
    return found if residual is None else found.where(residual)


class Indexes:
    """Index tables of a store, sorted by value so that files and row groups of other values are skipped.

    An index stays in use when its table is written to: keys in segments that are newer than the index are candidates
    for every value, next to the keys that the index has for it, and all conditions are applied to the rows found.
    """

    def __init__(self, store: Store, most: int = 1000):
        self.store, self.most = store, most

    def _folder(self, name: str, column: str) -> str:
        return f"{name.lower()}/index/{column.lower()}"

    def build(self, name: str, *columns: str) -> None:
        """An index of the first column; the others are sorted and kept along with it."""
        with self.store.lock:
            table, state = self.store.catalog.get(name), self.store.state(name)
            names = [table.column(c).name for c in columns]
            folder = self._folder(name, columns[0])
            df = self.store.view(name).select(F.col(names[0]).alias("value"), *names[1:], table.key_column().alias("key"))
            path = f"{folder}/{state['version']:012d}-{state['next']}"
            df.repartitionByRange("value", *names[1:]).sortWithinPartitions("value", *names[1:]).write.mode("overwrite").parquet(f"{self.store.root}/{path}")
            self.store.files.write(f"{folder}.json", json.dumps({"path": path, "next": state["next"]}))

    def candidates(self, name: str, column: str, value) -> DataFrame | None:
        """Keys among which all of a value are, or null without an index."""
        text = self.store.files.latest(f"{self._folder(name, column)}.json")[1]
        if not text:
            return None
        of, state = json.loads(text), self.store.state(name)
        base = self.store.spark.read.parquet(f"{self.store.root}/{of['path']}").where(F.col("value") == F.lit(value)).select("key")
        newer = [s for s in state["segments"] if int(s.rpartition("/")[2]) >= of["next"]]
        return base.union(self.store.keys(name, newer)) if newer else base

    def rows(self, name: str, column: str, value) -> DataFrame | None:
        """Current rows among which all with a value are, or null without an index.

        Few keys are looked up by themselves, so that files and row groups without them are skipped; more are joined.
        """
        keys = self.candidates(name, column, value)
        if keys is None:
            return None
        few = [r[0] for r in keys.distinct().limit(self.most + 1).collect()]  # at most ``most`` and one
        if len(few) <= self.most:
            return self.store.view(name, few)
        return self.store.view(name).withColumn("_key", self.store.catalog.get(name).key_column()).join(keys.withColumnRenamed("key", "_key"), "_key", "left_semi").drop("_key")

    def query(self, name: str, column: str, value) -> DataFrame:
        """Keys of a value, in order: through the index if there is one, else from all rows."""
        rows = self.rows(name, column, value)
        return lookup(entries(self.store.view(name) if rows is None else rows, column, self.store.catalog.get(name).key_column()), value)
