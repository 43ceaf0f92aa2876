"""Operation logs as streams: exactly-once append, duplicate suppression, current values, windows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.resolve import ORDER, latest
from quarry.sources.fs import Files
from quarry.sources.store import Store


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(form).load(path)


def distinct_operations(ops: DataFrame, time: str = "event_time", op_id: str = "op_id", within: str = "1 hour") -> DataFrame:
    """Each operation once, though delivered again within the watermark; order doesn't matter, so late ones aren't lost."""
    return ops.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark([op_id])


def current_values(ops: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """The last operation of each key, kept as state; deleted keys have is_delete set."""
    rest = [c for c in ops.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return ops.groupBy(*keys).agg(last).select(*keys, "_last.*")


def windowed_counts(events: DataFrame, time: str, every: str, late: str, *by: str) -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"))


def ingest(ops: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Append micro-batches of rows (and is_delete, if there is such a column) to a table's log.

    A batch is marked after it is added, under the id of the stream, which its checkpoint keeps. One that
    is run again after its mark adds nothing; one whose mark or checkpoint was lost adds the
    same rows again, which resolve to the same values.
    """
    table, own = store.catalog.get(name), Files(store.spark, checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        with store.lock:
            mark = f"{name.lower()}/_batches/{json.loads(own.read('metadata'))['id']}-{number}"
            if store.files.exists(mark):
                return
            gone = F.coalesce(F.col("is_delete"), F.lit(False)) if "is_delete" in batch.columns else False
            store.append(name, store.operations(table, batch, delete=gone))
            store.files.create(mark, "")

    return ops.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Run a stream of operations over what there is, and the last operation of each key.

    Each batch is reduced by key and added as files, and the files are resolved when they are read:
    neither the driver nor the stream's state holds the keys.
    """

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order, True).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = df.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest(df.sparkSession.read.schema(df.schema).parquet(path), keys, order, True)


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run over what there is, and the result as a table; for bounded results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
