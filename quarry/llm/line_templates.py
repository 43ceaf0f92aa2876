"""Line deduplication by a log-template tree.

Lines that differ only in variable fields (a date, an address, a counter) are one
template; templates that recur across documents are boilerplate, and their lines
are dropped everywhere.

* The tree has fixed depth: the number of tokens of a line, then its first
  ``depth`` tokens, those with a digit as a wildcard. Its leaves are counted over
  documents; leaves of fewer than ``min_docs`` documents can hold no template.
* Within a leaf a token at a place is constant at level k if lines of
  ``min_docs`` * 2^k documents have it there, else it is a variable field; at every
  level also with all tokens that have a digit as variable fields. A line has one
  template a level, its leaf and its constants there, so the values of a field that
  are frequent in a large corpus are still a field at a higher level than the rest
  of the line. A template needs ``min_const`` constants, and ``similar`` of its tokens.
  Unlike a sequential parser's, templates don't depend on the order of lines.
* A line is dropped if one of its templates recurs. A template recurs if it is found
  in ``min_docs`` different groups of documents. A group is a component of near
  duplicates, as the near-duplicate operator finds them, so copies and near copies
  count once, and documents that have no more in common than a passage to be dropped
  count each. Lines found in a single group of copies stay, which is for document
  deduplication to settle; a group doesn't keep a line that enough others have.

Counting is by aggregates that combine before they shuffle; no line's documents
meet in one task. Texts are shuffled twice: to tokenise the lines of frequent
leaves, and to drop lines; those with frequent templates also to group near copies.

Edge cases: null texts stay null and have no lines; empty texts have one empty
line. Lines of fewer than ``min_tokens`` tokens are never dropped. A text all of
whose lines are dropped becomes empty. Repeated rows are copies. Extra columns are
ignored by the operator. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, Chunk, Work, byte_table, chunks, mix, table
from .near_dedup import near_duplicates

_LINE = byte_table([0x0A])
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
WILD = U64(0x2A)


class Lines:
    """The non-empty lines of a chunk: text, number within it, tokens as hashes, and leaf."""

    def __init__(self, chunk: Chunk, depth: int):
        starts, ends, self.of = chunk.words(_LINE)
        # the number of a line: line feeds of its text before it
        feeds = np.concatenate([[0], np.cumsum(chunk.buf == 0x0A)])
        self.number = feeds[starts] - feeds[chunk.offs[self.of]]
        ts, te, _ = chunk.words(SPACE_WORDS)
        self.token = chunk.hashes(ts, te)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[chunk.buf])])
        self.digit = digits[te] > digits[ts]
        masked = np.where(self.digit, WILD, self.token)
        line = np.searchsorted(starts, ts, "right") - 1
        self.count = np.bincount(line, minlength=len(starts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        leaf = mix(self.count.astype(np.uint64) + U64(0x7F4A7C15))
        for d in range(depth):
            has = np.flatnonzero(self.count > d)
            leaf[has] = mix(leaf[has] * U64(0x9E3779B97F4A7C15) + masked[self.first[has] + d])
        self.leaf = leaf


def _leaves(depth: int, min_tokens: int):
    """Rows (row, leaf, lines): the lines of each leaf in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches):
            x = Lines(chunk, depth)
            keep = np.flatnonzero(x.count >= min_tokens)
            row = np.asarray(batch.column(0))[x.of[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(x.leaf[keep].view(np.int64)), pa.array(x.number[keep].astype(np.int32))], ["row", "leaf", "line"])

    return run


def _tokens(depth: int):
    """Rows for the named lines of each text: their tokens, and what identifies the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches):
            x = Lines(chunk, depth)
            whole = chunk.hashes(chunk.offs[:-1], chunk.offs[1:])
            wanted = batch.column(2)
            named = np.repeat(np.arange(chunk.n), np.asarray(wanted.value_lengths()))
            key = np.sort(named * (1 << 32) + np.asarray(wanted.flatten(), dtype=np.int64))
            own = x.of * (1 << 32) + x.number
            place = np.minimum(np.searchsorted(key, own), len(key) - 1) if len(key) else np.zeros(len(own), np.int64)
            at = np.flatnonzero(key[place] == own) if len(key) else np.zeros(0, np.int64)
            size = x.count[at]
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = np.repeat(x.first[at] - offs[:-1], size) + np.arange(offs[-1])
            tokens = x.token[flat] & ~U64(1) | x.digit[flat].astype(np.uint64)  # the lowest bit marks tokens with a digit
            line = mix(np.add.reduceat(mix(tokens + np.arange(len(tokens)).astype(np.uint64) - np.repeat(offs[:-1], size).astype(np.uint64)), offs[:-1])) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.asarray(batch.column(0))[x.of[at]]),
                    pa.array(x.number[at].astype(np.int32)),
                    pa.array(x.leaf[at].view(np.int64)),
                    pa.array(line.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(tokens.view(np.int64))),
                    pa.array(whole[x.of[at]].view(np.int64)),
                ],
                ["row", "line", "leaf", "hash", "tokens", "text"],
            )

    return run


def _constants(wanted: Callable[[Column], Column]) -> Column:
    """Of the constants c (at, token, level) of a line the wanted ones, (at, token), once for each level."""
    levels = F.array_distinct(F.transform("c", lambda x: x["level"]))
    return F.transform(levels, lambda k: F.transform(F.filter("c", lambda x: (x["level"] >= k) & wanted(x)), lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))


def drop_recurring_lines(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    min_docs: int = 20,
    min_tokens: int = 3,
    min_const: int = 3,
    similar: float = 0.6,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Return doc_id, the named columns of docs, n_lines, n_dropped, dropped (line numbers from 0) and text (without them), one row per row of docs."""
    work = Work(spark, "lines")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *columns).alias("own"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    lines = docs.select("row", "text").mapInArrow(_leaves(depth, min_tokens), "row long, leaf long, line int")
    lines = work.write(lines, "leaves")
    frequent = lines.groupBy("leaf").agg(F.count_distinct("row").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    # Neither side of the joins below has a bound: merged, never broadcast. The counted side is written first, so
    # that the join deals both sides itself and can split the partitions of a very common leaf, token or template.
    frequent = work.write(frequent, "frequent")
    wanted = lines.join(frequent.hint("merge"), "leaf").groupBy("row").agg(F.collect_set("line").alias("lines"))
    read = docs.select("row", "text").join(wanted.hint("merge"), "row")
    lines = work.write(read.mapInArrow(_tokens(depth), "row long, line int, leaf long, hash long, tokens array<long>, text long"), "lines")
    work.drop("leaves")
    distinct = work.write(lines.groupBy("leaf", "hash").agg(F.count_distinct("row").alias("n"), F.first("tokens").alias("tokens")), "distinct")
    places = distinct.select("leaf", "hash", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "token"))
    constant = places.groupBy("leaf", "at", "token").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    constant = constant.select("leaf", "at", "token", F.floor(F.log2(F.col("docs") / min_docs)).cast("int").alias("level"))
    constant = work.write(constant, "constant")
    kept = places.join(constant.hint("merge"), ["leaf", "at", "token"]).groupBy("leaf", "hash", "size").agg(F.sort_array(F.collect_list(F.struct("at", "token", "level"))).alias("c"))
    sets = F.array_distinct(F.concat(_constants(lambda x: F.lit(True)), _constants(lambda x: x["token"].bitwiseAND(1) == 0)))
    kept = kept.where(F.size("c") >= min_const).select("leaf", "hash", "size", F.explode(sets).alias("c"))
    kept = kept.where((F.size("c") >= min_const) & (F.size("c") >= similar * F.col("size")))
    templates = work.write(kept.select("leaf", "hash", F.xxhash64("leaf", "c").alias("template")), "templates")
    found = work.write(lines.select("row", "line", "leaf", "hash", "text").join(templates.hint("merge"), ["leaf", "hash"]).select("row", "line", "template", "text"), "found")
    # only texts of templates that recur in different texts, copies or not, need groups
    many = found.groupBy("template").agg(F.count_distinct("text").alias("texts")).where(F.col("texts") >= min_docs)
    many = work.write(many.select("template"), "many")
    open_ = work.write(found.join(many.hint("merge"), "template").select("template", "row").distinct(), "open")
    rows = work.write(open_.select("row").distinct(), "rows")
    groups = near_duplicates(spark, docs.select("row", "text").join(rows.hint("merge"), "row", "left_semi").dropDuplicates(["row"]), id_col="row")
    groups = work.write(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("near")), "groups")
    spread = open_.join(groups.hint("merge"), "row").select("template", "near").distinct().groupBy("template").agg(F.count("*").alias("near"))
    recurring = spread.where(F.col("near") >= min_docs).select("template")
    recurring = work.write(recurring, "recurring")
    dropped = found.join(recurring.hint("merge"), "template").groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    dropped = work.write(dropped, "dropped")
    out = docs.join(dropped.hint("merge"), "row", "left")
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda _, i: ~F.array_contains("dropped", i))
    n = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        *(F.col("own").getField(c).alias(c) for c in columns),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(n).cast("long").alias("n_dropped"),
        "dropped",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )


def op1_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
