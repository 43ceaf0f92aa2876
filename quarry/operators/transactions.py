"""Transactions over a store, and reports on conflicts in a history of operations.

A transaction stages its operations in a folder of its own, which is there as long as it
is open: without it, after an abort by id, it can't commit. Commit checks, under
the store's lock, that no segment added since its start wrote a key that it
read or writes (the first to commit wins), then adds the staged operations to the
logs of all its tables and then its marker, from when on all of them are seen. Its own reads see its own writes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.resolve import ORDER, latest
from quarry.sources.store import Store


class Conflict(RuntimeError):
    pass


class InsufficientFunds(RuntimeError):
    pass


class Transaction:
    def __init__(self, store: Store):
        self.store, self.id, self.start = store, uuid.uuid4().hex, store.tick()
        self.staged: dict[str, DataFrame] = {}
        self.read: dict[str, set[str]] = {}
        self.open = True
        store.files.create(f"_tx/{self.id}/start", str(self.start))

    def _stage(self, name: str, ops: DataFrame) -> None:
        if not self.open:
            raise RuntimeError("the transaction is closed")
        before = self.staged.get(name)
        path = f"{self.store.root}/_tx/{self.id}/{name.lower()}-{uuid.uuid4().hex}"
        (ops if before is None else before.unionByName(ops)).write.parquet(path)
        self.staged[name] = self.store.spark.read.schema(ops.schema).parquet(path)

    def put(self, name: str, rows: DataFrame) -> None:
        table = self.store.catalog.get(name)
        self._stage(name, self.store.operations(table, table.aligned(rows), tx_id=self.id))

    def delete(self, name: str, rows: DataFrame) -> None:
        self._stage(name, self.store.operations(self.store.catalog.get(name), rows, delete=True, tx_id=self.id))

    def get(self, name: str, *key) -> DataFrame:
        """The row of a key; the key joins the read set."""
        table = self.store.catalog.get(name)
        full = table.key_of(*key)
        self.read.setdefault(name, set()).add(full)
        ops = self.store.resolved(name, tombstones=True)
        if name in self.staged:
            ops = latest(ops.unionByName(self.staged[name]), ["key"], ORDER, True)
        return ops.where((F.col("key") == full) & ~F.col("is_delete")).select("row.*")

    def commit(self) -> None:
        with self.store.lock:
            if not self.store.files.exists(f"_tx/{self.id}/start"):
                raise self._failed("the transaction was aborted")
            for name in {*self.staged, *self.read}:
                since = self.store.log(name).where(F.col("ts") > self.start).select("key")
                read = sorted(self.read.get(name, ()))
                if read and not since.where(F.col("key").isin(read)).isEmpty():
                    raise self._failed(f"{name}: a key that was read has changed")
                if name in self.staged and not self.staged[name].join(since, "key", "left_semi").isEmpty():
                    raise self._failed(f"{name}: a key that is written has changed")
                if name in self.staged:
                    self.store.check_unique(self.store.catalog.get(name), latest(self.staged[name], ["key"]).select("row.*"))
            stamp = self.store.tick()
            for name, ops in self.staged.items():
                # stamped anew: the commit is what others see
                self.store.append(name, ops.withColumn("ts", F.lit(stamp)), tx=self.id)
            self.store.files.create(f"_committed/{self.id}", str(stamp))
            for name in self.staged:
                self.store.settle(name)
            self.store.files.delete(f"_committed/{self.id}")  # no state names it any longer
            self.abort()

    def _failed(self, why: str) -> Conflict:
        self.abort()
        return Conflict(why)

    def abort(self) -> None:
        self.open = False
        self.store.files.delete(f"_tx/{self.id}")


def open_transactions(store: Store) -> DataFrame:
    """(tx, start) of the transactions that are neither committed nor aborted."""
    rows = [(i, int(store.files.read(f"_tx/{i}/start"))) for i in store.files.names("_tx") if store.files.exists(f"_tx/{i}/start")]
    return store.spark.createDataFrame(rows, "tx string, start long")


def balances(ops: DataFrame, key: str, amount: str) -> DataFrame:
    """Sums of increments; amounts that aren't numbers count as 0."""
    return ops.groupBy(key).agg(F.sum(F.coalesce(F.col(amount).try_cast("double"), F.lit(0.0))).alias("balance"))


def transfer(store: Store, name: str, column: str, source, target, amount: float) -> None:
    """Move an amount between two rows, or raise InsufficientFunds and change nothing."""
    with store.lock:
        tx = Transaction(store)
        rows = {}
        for k in (source, target):
            got = tx.get(name, k).collect()  # one row: a full key
            if not got:
                tx.abort()
                raise KeyError(k)
            rows[k] = got[0].asDict()
        if rows[source][column] < amount:
            tx.abort()
            raise InsufficientFunds(f"{source} has {rows[source][column]}")
        rows[source][column] -= amount
        rows[target][column] += amount
        schema = store.catalog.get(name).row_type
        tx.put(name, store.spark.createDataFrame(list(rows.values()), schema))
        tx.commit()


def write_conflicts(reads: DataFrame, writes: DataFrame, key: str = "key") -> DataFrame:
    """Reads (tx, key, at, until) whose key another transaction wrote (tx, key, at) in between."""
    w = writes.select(F.col(key), F.col("tx").alias("other"), F.col("at").alias("written"))
    return reads.join(w, key).where((F.col("other") != F.col("tx")) & (F.col("written") > F.col("at")) & (F.col("written") <= F.col("until"))).select("tx", "other", key).distinct()


def serialization_conflicts(transactions: DataFrame, reads: Column | str = "reads", writes: Column | str = "writes") -> DataFrame:
    """Pairs (tx, other): other committed between tx's start and commit and wrote what tx read.

    Sets are exploded and joined by key, so transactions that share nothing never meet.
    """
    r = transactions.select("tx", "start", "commit", F.explode(reads).alias("key"))
    w = transactions.select(F.col("tx").alias("other"), F.col("commit").alias("done"), F.explode(writes).alias("key"))
    met = r.join(w, "key").where((F.col("other") != F.col("tx")) & (F.col("done") > F.col("start")) & (F.col("done") < F.col("commit")))
    return met.select("tx", "other").distinct()


def acknowledged(last_seen: DataFrame, seq: str = "seq") -> DataFrame:
    """The sequence number up to which all replicas have seen everything."""
    return last_seen.agg(F.min(seq).alias("acknowledged"))
