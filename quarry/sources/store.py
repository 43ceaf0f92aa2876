"""Mutable tables kept as an append-only operation log with snapshots.

Below the root each table has segments of operations (Parquet folders, added one
a write) and at most one snapshot, the resolved rows of all operations up to it.
Numbered state files name both; the last one counts, so readers see a state before
or after a write, wherever a writer stops. A read resolves only the keys that operations since the snapshot
touch; all other rows come from the snapshot as they are. After ``flush_at`` segments
a write ends with a compaction.

Segments of a transaction carry its id until its marker is written, after those of all
its tables: without the marker no reader sees any of them.

Operations of the store's own origin are numbered on from its last one. A lock in the driver orders
the writers of one process; of two processes that write the same state one fails.
"""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.catalog import Catalog, TableDef, ValidationError
from quarry.functions.clocks import Lamport
from quarry.operators.resolve import ORDER, latest
from quarry.sources.fs import Files

VC = T.MapType(T.StringType(), T.LongType())


def op_schema(table: TableDef) -> T.StructType:
    return T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("partition_key", T.StringType()),
            T.StructField("clustering_key", T.StringType()),
            T.StructField("ts", T.LongType()),
            T.StructField("origin", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("op_id", T.StringType()),
            T.StructField("vc", VC),
            T.StructField("tx_id", T.StringType()),
            T.StructField("is_delete", T.BooleanType()),
            T.StructField("row", table.row_type),
        ]
    )


class Store:
    def __init__(self, spark: SparkSession, root: str, origin: str = "local", flush_at: int = 64):
        self.spark, self.root, self.origin, self.flush_at = spark, root.rstrip("/"), origin, flush_at
        self.files = Files(spark, self.root)
        self.catalog = Catalog(self.files)
        self.lock = threading.RLock()
        self.clock = Lamport(int(time.time() * 1000))

    # state

    def _latest(self, name: str) -> tuple[int, dict]:
        number, text = self.files.latest(f"{name.lower()}/_state")
        if text:
            return number, json.loads(text)
        if self.files.names(f"{name.lower()}/ops") or self.files.names(f"{name.lower()}/snapshots"):
            raise RuntimeError(f"table {name} has data, but no state")
        return number, {"segments": [], "snapshot": None, "version": 0, "next": 0, "seq": {}, "ts": 0, "horizon": 0}

    def _live(self, segment: str) -> bool:
        _, _, tx = segment.partition("@")
        return not tx or self.files.exists(f"_committed/{tx}")

    def state(self, name: str) -> dict:
        """The state as readers see it: without segments of transactions that have no marker."""
        state = self._latest(name)[1]
        return {**state, "segments": [s.partition("@")[0] for s in state["segments"] if self._live(s)]}

    def _put_state(self, name: str, number: int, state: dict) -> None:
        if not self.files.replace(f"{name.lower()}/_state", number, json.dumps({**state, "version": state["version"] + 1})):
            raise RuntimeError(f"another process has written to {name}")

    def settle(self, name: str) -> None:
        """Drop the ids of committed transactions from the state."""
        with self.lock:
            number, state = self._latest(name)
            self._put_state(name, number, {**state, "segments": [s.partition("@")[0] if self._live(s) else s for s in state["segments"]]})

    def _read(self, table: TableDef, folders: list[str]) -> DataFrame:
        schema = op_schema(table)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table.name.lower()}/{f}" for f in folders))

    # writes

    def operations(self, table: TableDef, rows: DataFrame, *, delete: bool | Column = False, ts: int | Column | None = None, tx_id: str | None = None, vc: Column | None = None) -> DataFrame:
        """Operations that write, or delete, rows of the table's columns."""
        keys = table.keys
        mark = delete if isinstance(delete, Column) else F.lit(delete)
        stamp = ts if isinstance(ts, Column) else F.lit(self.tick() if ts is None else ts)
        seq = F.monotonically_increasing_id()  # until it is appended
        clustering = F.concat_ws("|", *(F.col(k).cast("string") for k in keys[1:])) if keys[1:] else F.lit(None).cast("string")
        return rows.select(
            table.key_column().alias("key"),
            F.col(keys[0]).cast("string").alias("partition_key"),
            clustering.alias("clustering_key"),
            stamp.cast("long").alias("ts"),
            F.lit(self.origin).alias("origin"),
            seq.alias("seq"),
            F.concat_ws(":", F.lit(self.origin), stamp.cast("string"), seq.cast("string")).alias("op_id"),
            (vc if vc is not None else F.lit(None)).cast(VC).alias("vc"),
            F.lit(tx_id).cast("string").alias("tx_id"),
            mark.alias("is_delete"),
            F.struct(*(F.col(c.name) for c in table.columns)).alias("row"),
        )

    def tick(self) -> int:
        return self.clock.tick()

    def append(self, name: str, ops: DataFrame, tx: str | None = None) -> None:
        """Add operations; those of a transaction are seen once it is marked as committed."""
        with self.lock:
            number, state = self._latest(name)
            folder = f"ops/{state['next']:08d}"
            own = F.col("origin") == self.origin
            # numbered on from the last write, in the order of the rows
            ops = ops.withColumn("seq", F.when(own, F.lit(state["seq"].get(self.origin, 0)) + F.monotonically_increasing_id()).otherwise(F.col("seq")))
            ops = ops.withColumn("op_id", F.when(own, F.concat_ws(":", "origin", F.col("ts").cast("string"), F.col("seq").cast("string"))).otherwise(F.col("op_id")))
            path = f"{self.root}/{name.lower()}/{folder}"
            ops.write.mode("overwrite").parquet(path)
            last = self.spark.read.parquet(path).groupBy("origin").agg(F.max("seq").alias("seq")).collect()  # one row an origin
            seq = {**state["seq"], **{r["origin"]: max(state["seq"].get(r["origin"], 0), r["seq"] + 1) for r in last if r["seq"] is not None}}
            segment = f"{folder}@{tx}" if tx else folder
            self._put_state(name, number, {**state, "segments": [*state["segments"], segment], "next": state["next"] + 1, "seq": seq})
            if tx is None and len(state["segments"]) + 1 >= self.flush_at:
                self.compact(name)

    def check_unique(self, table: TableDef, rows: DataFrame) -> None:
        """Raise if rows to be written would give two keys one value of a UNIQUE index; null is no value."""
        for i in (i for i in table.indexes if i.unique):
            new = rows.select(*i.columns, table.key_column().alias("_key")).dropna(subset=i.columns).distinct()
            kept = self.view(table.name).select(*i.columns, table.key_column().alias("_key")).dropna(subset=i.columns).join(new.select("_key"), "_key", "left_anti")
            if not kept.join(new.select(*i.columns).distinct(), i.columns, "left_semi").unionByName(new).groupBy(*i.columns).agg(F.count_distinct("_key").alias("n")).where("n > 1").isEmpty():
                raise ValidationError(f"index {i.name} of {table.name} is unique")

    def put(self, name: str, rows: DataFrame, **options) -> None:
        table = self.catalog.get(name)
        rows = table.aligned(rows)
        with self.lock:
            self.check_unique(table, rows)
            self.append(name, self.operations(table, rows, **options))

    def delete(self, name: str, rows: DataFrame, **options) -> None:
        table = self.catalog.get(name)
        self.append(name, self.operations(table, rows, delete=True, **options))

    # reads

    def log(self, name: str) -> DataFrame:
        """All operations that are still kept, the snapshot's included."""
        table, state = self.catalog.get(name), self.state(name)
        return self._read(table, ([state["snapshot"]] if state["snapshot"] else []) + state["segments"])

    def keys(self, name: str, segments: list[str]) -> DataFrame:
        """Keys that operations of the given segments have."""
        return self._read(self.catalog.get(name), segments).select("key").distinct()

    def resolved(self, name: str, tombstones: bool = False, keys: list[str] | None = None) -> DataFrame:
        """The last operation of each key, or of the given keys."""
        table, state = self.catalog.get(name), self.state(name)

        def read(folders: list[str]) -> DataFrame:
            out = self._read(table, folders)
            return out if keys is None else out.where(F.col("key").isin(keys))

        fresh = read(state["segments"])
        if not state["snapshot"]:
            out = latest(fresh, ["key"], ORDER, True)
        elif not state["segments"]:
            out = read([state["snapshot"]])
        else:
            base = read([state["snapshot"]])
            touched = fresh.select("key").distinct()
            again = base.join(touched, "key", "left_semi").unionByName(fresh)
            out = base.join(touched, "key", "left_anti").unionByName(latest(again, ["key"], ORDER, True))
        return out if tombstones else out.where(~F.col("is_delete"))

    def view(self, name: str, keys: list[str] | None = None) -> DataFrame:
        """The current rows, or those of the given keys, with the table's columns."""
        table = self.catalog.get(name)
        cols = [F.col(f"row.{c.name}").alias(c.name) for c in table.columns]
        return self.resolved(name, keys=keys).select(*cols)

    def compact(self, name: str, horizon: int | None = None) -> None:
        """Write a new snapshot. Tombstones go only below the horizon, up to which every writer's operations have come in."""
        with self.lock:
            table, (number, state) = self.catalog.get(name), self._latest(name)
            seen = self.state(name)
            horizon = state["horizon"] if horizon is None else horizon
            rows = self.resolved(name, tombstones=True).where(~F.col("is_delete") | (F.col("ts") >= horizon))
            folder = f"snapshots/{state['next']:08d}"
            rows.repartitionByRange(F.col("key")).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.root}/{name.lower()}/{folder}")
            waiting = [s for s in state["segments"] if not self._live(s)]
            self._put_state(name, number, {**state, "segments": waiting, "snapshot": folder, "next": state["next"] + 1, "horizon": horizon})
            for old in [*seen["segments"], *([state["snapshot"]] if state["snapshot"] else [])]:
                self.files.delete(f"{table.name.lower()}/{old}")

    def segment(self, name: str, number: int) -> DataFrame:
        """The operations of one segment, by its place in the log."""
        return self._read(self.catalog.get(name), [self.state(name)["segments"][number]])

    def segments(self, name: str) -> DataFrame:
        """(segment, kb, items, first_key, last_key) of each folder of the table."""
        df = self.log(name).select("key", F.regexp_extract(F.col("_metadata.file_path"), r"(ops|snapshots)/(\d+)/", 0).alias("segment"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
        files = df.groupBy("segment", "f").agg(F.max("b").alias("b"), F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z"))
        return files.groupBy("segment").agg((F.sum("b") / 1024).alias("kb"), F.sum("n").alias("items"), F.min("a").alias("first_key"), F.max("z").alias("last_key"))
