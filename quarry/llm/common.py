"""Helpers shared by the training-data operators.

Texts travel to Python as Arrow batches, are cut into chunks of bounded bytes
(a longer text is a chunk of its own) and are tokenised and hashed there with
numpy over the whole chunk at once, so no loop runs over words.

Null texts count as empty everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, and let shuffle files go with the query that made them."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # a release without the setting works as well, with larger batches
            if "CANNOT_MODIFY" not in str(e):
                raise


class Work:
    """Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

    Writing a table cuts the lineage: a lost executor costs the rerun of the
    step in hand, not of the steps before it. ``drop`` frees tables that no
    later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = f"file://{tempfile.gettempdir()}/checkpoints"
        self.base = f"{base}/{name}-{uuid.uuid4().hex}"
        tune(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_table(separators: Iterable[int]) -> np.ndarray:
    """For each byte value, whether it belongs to a word."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: Words are what white space separates.
SPACE_WORDS = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are letters, digits and all characters beyond ASCII; A-Z count, as they are hashed as a-z.
ALNUM_WORDS = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(31))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = []
        for base in (_MULT, _INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


class Chunk:
    """Some whole texts in one buffer: text i is buf[offs[i]:offs[i+1]]."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.n = len(column)
        if not self.n:
            self.buf, self.offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)
            return
        offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = whole[offs[0] : offs[-1]]
        self.offs = offs - offs[0]

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in buf, and the text of each."""
        m = is_word[self.buf]
        before = np.zeros_like(m)
        after = np.zeros_like(m)
        if len(m):
            before[1:] = m[:-1]
            after[:-1] = m[1:]
            cuts = self.offs[:-1]
            before[cuts[cuts < len(m)]] = False
            cuts = self.offs[1:]
            after[cuts[cuts > 0] - 1] = False
        starts = np.flatnonzero(m & ~before)
        ends = np.flatnonzero(m & ~after) + 1
        return starts, ends, np.searchsorted(self.offs, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of pieces of buf."""
        n = len(self.buf)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        code = BYTE_CODE[LOWER] if lower else BYTE_CODE
        np.cumsum(code[self.buf] * power[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items; the caller drops those that cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[i : len(h) - n + 1 + i]
        out ^= out >> U64(32)
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Slices of the batches with at most so many bytes of text, or with one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            part = batch.slice(at, to - at)
            yield part, Chunk(part.column(text))
            at = to


def pack(rows: np.ndarray) -> pa.Array:
    """A 2-d array of numbers as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offs = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(rows)])


def unpack(column: pa.Array, dtype, width: int) -> np.ndarray:
    """What pack() made, of rows without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=dtype).reshape(len(column), width)


def salted(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def carrying(docs: DataFrame, ident: Column, text_col: str, columns: tuple[str, ...]) -> tuple[DataFrame, str, int]:
    """Rows (doc_id, text, other columns) for a function over Arrow batches that hands columns through.

    Also their part of the result's schema, and the place from which the batch's columns
    are handed through: with the text, if it is among them, so that it travels once.
    """
    keep = text_col in columns
    rest = [c for c in columns if c != text_col]
    docs = docs.select(ident.alias("doc_id"), F.col(text_col).alias(text_col if keep else "_text"), *rest)
    names = [text_col] * keep + rest
    return docs, "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names), 1 if keep else 2


def bounded_sample(df: DataFrame, key: Column, size: int) -> DataFrame:
    """``size`` rows, the same for any partitioning: those with the smallest hash of the key.

    A first cut at a hash value leaves about three times as many, so the rows
    that meet to be ordered don't grow with the table or its partitions.
    """
    n = df.count()
    part = min(1.0, (3 * size + 100) / max(1, n))
    df = df.withColumn("_h", F.xxhash64(key.cast("string"))).where(F.pmod("_h", F.lit(1_000_003)) <= int(part * 1_000_003))
    return df.orderBy(F.pmod("_h", F.lit(1_000_003)), "_h").limit(size).drop("_h")


def connected_components(spark: SparkSession, edges: DataFrame, work: Work, tag: str) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (u, v), for nodes with an edge to another.

    Alternates the large-star and small-star steps, which keep the components
    and bring each node next to its smallest; every step aggregates before it
    shuffles and joins with a table of one row a node. Each step is written,
    so the plan doesn't grow with the rounds, and sums over its rows are taken as they
    are written: when a large-star step changes nothing and no node has two smaller
    neighbours, every node is next to its smallest.
    """

    def written(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        out = work.write(df, name)
        return out, tuple(seen.get[c] for c in ("n", "h", "v"))

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    (e, was), k = written(e, f"{tag}-0"), 0
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, now = written(large, f"{tag}-large-{k}")
        if now == was and large.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        k += 1
        e, was = written(small, f"{tag}-{k}")
        work.drop(f"{tag}-{k - 1}", f"{tag}-large-{k - 1}")
