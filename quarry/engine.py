"""One object for all that a client asks of the engine; every answer is a DataFrame.

Nodes, heartbeats, quorums and request routing have no counterpart: Spark places
and reruns the work. What remains of a cluster's administration are reports over
the operation log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions.hashing import Ring, hash_partition
from quarry.operators import load, merkle, scans
from quarry.operators.transactions import Transaction, open_transactions, transfer
from quarry.plans.sql import Sql
from quarry.sources.fs import scratch
from quarry.sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, partitions: int = 128, ring: Ring | None = None):
        self.spark, self.partitions_, self.ring = spark, partitions, ring or Ring((("n0", 8), ("n1", 8), ("n2", 8)))
        self.store = Store(spark, root or scratch(spark, "store"))
        self.sql_ = Sql(self.store)

    # data

    def put(self, table: str, **row) -> None:
        schema = self.store.catalog.get(table).row_type
        names = [f for f in schema.fieldNames() if f in row]
        unknown = set(row) - set(names)
        df = self.spark.createDataFrame([tuple(row[n] for n in names)], f"struct<{', '.join(f'{n}: {schema[n].dataType.simpleString()}' for n in names)}>")
        for n in unknown:
            df = df.withColumn(n, F.lit(row[n]))
        self.store.put(table, df)

    def get(self, table: str, *key) -> DataFrame:
        return self.store.view(table, [self.store.catalog.get(table).key_of(*key)])

    def versions(self, table: str, *key) -> DataFrame:
        full = self.store.catalog.get(table).key_of(*key)
        return self.store.log(table).where(F.col("key") == full).orderBy("ts", "origin", "seq")

    def delete(self, table: str, *key) -> None:
        self.store.delete(table, self.get(table, *key))

    def records(self, table: str, offset: int = 0, limit: int | None = None, query: str | None = None) -> DataFrame:
        rows = self.store.resolved(table).select("key", "partition_key", "clustering_key", F.to_json("row").alias("value"))
        return scans.page(rows, ["key"], offset, limit, query, ["partition_key", "clustering_key", "value"])

    def scan_range(self, table: str, partition: str, start: str, end: str) -> DataFrame:
        return scans.scan_range(self.store.resolved(table), F.col("partition_key") == partition, "clustering_key", start, end).select("row.*")

    def query_index(self, table: str, column: str, value) -> DataFrame:
        return self.sql_.indexes.query(table, column, value)

    def increment(self, table: str, column: str, key, amount: float) -> None:
        tx = Transaction(self.store)
        rows = tx.get(table, key).collect()  # one row
        now = rows[0].asDict() if rows else {self.store.catalog.get(table).keys[0]: key}
        old = now.get(column)
        total = (old if isinstance(old, (int, float)) else 0) + amount
        now[column] = float(total) if self.store.catalog.get(table).row_type[column].dataType == DoubleType() else total
        tx.put(table, self.spark.createDataFrame([now], self.store.catalog.get(table).row_type))
        tx.commit()

    def transfer(self, table: str, column: str, source, target, amount: float) -> None:
        transfer(self.store, table, column, source, target, amount)

    def begin(self) -> Transaction:
        return Transaction(self.store)

    def transactions(self) -> DataFrame:
        return open_transactions(self.store)

    def abort(self, tx: str) -> None:
        """A transaction that is aborted by its id fails when it is committed."""
        self.store.files.delete(f"_tx/{tx}")

    # SQL and catalog

    def sql(self, text: str) -> DataFrame:
        return self.sql_.execute(text)

    def explain(self, text: str) -> DataFrame:
        return self.sql_.execute(f"EXPLAIN {text}")

    def tables(self) -> DataFrame:
        rows = [(n, len(self.store.catalog.get(n).columns)) for n in self.store.catalog.names()]
        return self.spark.createDataFrame(rows, "name string, columns int")

    def describe(self, table: str) -> DataFrame:
        t = self.store.catalog.get(table)
        rows = [(c.name, c.type, c.primary_key, c.nullable, c.default) for c in t.columns]
        return self.spark.createDataFrame(rows, "name string, type string, primary_key boolean, nullable boolean, default string")

    def table_stats(self, table: str) -> DataFrame:
        s = self.store.catalog.stats(table) or {"num_rows": None}
        return self.spark.createDataFrame([(table, s["num_rows"])], "name string, num_rows long")

    def column_stats(self, table: str) -> DataFrame:
        s = self.store.catalog.stats(table) or {"num_distinct": {}}
        return self.spark.createDataFrame(list(s["num_distinct"].items()), "column string, num_distinct long")

    # reports

    def partitions(self, table: str) -> DataFrame:
        ops = self.store.log(table).withColumn("pid", hash_partition(F.col("key"), self.partitions_))
        counts = load.partition_counts(self.spark, ops, "pid", self.partitions_, "key")
        owners = self.spark.createDataFrame(list(load.rebalanced(self.partitions_, sorted({n for n, _ in self.ring.nodes})).items()), "pid int, owner string")
        return counts.join(owners, "pid")

    def hotspots(self, table: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
        counts = self.partitions(table)
        return load.hot_partitions(counts), load.hot_keys(self.store.log(table), "key", n)

    def time_series(self, table: str, seconds: int = 60) -> DataFrame:
        at = (F.floor(F.col("ts") / (1000 * seconds)) * seconds).cast("timestamp").alias("time")
        return self.store.log(table).groupBy(at).agg(F.count("*").alias("ops")).orderBy("time")

    def replication(self, table: str) -> DataFrame:
        return self.store.log(table).groupBy("origin").agg(F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"), F.count("*").alias("ops"))

    def log(self, table: str) -> DataFrame:
        return self.store.log(table)

    def segments(self, table: str) -> DataFrame:
        return self.store.segments(table)

    def updates(self, table: str, seen: DataFrame) -> DataFrame:
        """Operations that a peer lacks, who has seen those up to (origin, seq)."""
        return self.store.log(table).join(seen.select("origin", F.col("seq").alias("_s")), "origin", "left").where(F.col("_s").isNull() | (F.col("seq") > F.col("_s"))).drop("_s")

    def merkle_root(self, table: str) -> str:
        rows = self.store.resolved(table).select("key", F.to_json("row").alias("value"))
        return merkle.root(self.spark, rows, "key", "value", scratch(self.spark, "merkle"))

    def events(self, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
        return scans.page(scans.event_log(self.spark.read.text(path)), ["time", "message"], offset, limit)

    def compact(self, table: str) -> None:
        self.store.compact(table)

