"""Benchmark decontamination with an FM-index per training shard.

A shard is a chunk of whole texts (a few MB). Its words are numbered by the
vocabulary of the benchmark block; every run of other words, and every end of a
text, is one separator. Runs with fewer words than the shortest window are left
out of the index, since no window can lie in them; nothing else is.

Over that sequence the shard builds a suffix array (prefix doubling, separators
all distinct), from it the Burrows-Wheeler transform, a wavelet tree of the
transform laid out level by level, and samples of the suffix array at every
``sample``-th position of a run. All windows of the block are searched backwards
at once; matching rows walk back with LF-mapping to the next sampled position.
Occurrences mark their words, and marked words merge into removal spans.

The benchmark is read in blocks of bounded bytes; only one block's windows are
sent to the executors at a time, and each block is held against all texts. Each
block's findings are handed on with the row to the next block and merged there, so
the number of blocks doesn't show in the result. What is dealt to blocks are distinct runs
of ``piece`` words, so neither a long item nor one that repeats fills a block.

Edge cases: null and empty texts have no words, no spans and no items. Items
without words or without an id take no part. An item of fewer words than a
window is one window. Items with equal windows are all reported. Repeated rows
of documents, and rows without an id, are each reported. An empty benchmark or table gives empty findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Chunk, Work, carrying, chunks, table, tune

SPAN = "array<struct<start:int,end:int>>"


class Windows:
    """The distinct windows of a block of items: words by number, and the items of each."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        chunk = Chunk(pa.array([t for _, t in items], pa.string()))
        starts, ends, of = chunk.words(ALNUM_WORDS)
        h = chunk.hashes(starts, ends, lower=True)
        self.vocabulary = np.unique(h)
        number = np.searchsorted(self.vocabulary, h) + 1
        count = np.bincount(of, minlength=chunk.n)
        n = np.where(count > 0, np.maximum(1, count - width + 1), 0)  # windows of each item
        item = np.repeat(np.arange(chunk.n), n)
        length = np.minimum(count, width)[item]
        start = (np.cumsum(count) - count)[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        words = np.zeros((len(item), width), dtype=np.int64)  # aligned to the right
        inside = np.arange(width) >= width - length[:, None]
        words[inside] = number[(start[:, None] + np.arange(width) - (width - length)[:, None])[inside]]
        self.words, which = np.unique(words, axis=0, return_inverse=True)
        self.length = (self.words > 0).sum(axis=1)
        self.shortest = int(self.length.min()) if len(self.words) else 0
        pairs = np.unique(np.stack([which.reshape(-1), np.array([i for i, _ in items], dtype=np.int64)[item]], axis=1), axis=0)
        self.item = pairs[:, 1]
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Of numbers in which each 0 is a separator, smaller than all else and differing from other separators."""
    n = len(seq)
    zero = seq == 0
    rank = seq + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    k = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[:-k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if new[-1] == n - 1 or k >= n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        k *= 2


class FMIndex:
    """Counts and locates sequences of numbers from 1 in seq; 0 is a separator, also at the end of seq."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        order = suffix_array(seq)
        n = len(seq)
        bwt = seq[order - 1]
        # first[c]: rows of suffixes that start with a smaller number
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        self.levels: list[tuple[int, np.ndarray, int]] = []
        x = bwt
        for bit in range(int(x.max()).bit_length() - 1, -1, -1):
            one = (x >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            x = np.concatenate([x[~one], x[one]])
        self.base = self._down(np.arange(len(self.first)), np.zeros(len(self.first), dtype=np.int64))
        # sampled: every sample-th position of a run, its start included
        start = np.flatnonzero(np.concatenate([[True], seq[:-1] == 0]))
        offset = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        marked = (offset % sample == 0)[order]
        self.marked = marked
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]
        self.n = n

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, zeros, total in self.levels:
            z = zeros[i]
            i = np.where(c >> bit & 1, total + i - z, z)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs among the first i numbers of the transform."""
        return self._down(c, i) - self.base[c]

    def step(self, i: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one longer than those of rows i."""
        c = np.zeros(len(i), dtype=np.int64)
        for bit, zeros, total in self.levels:
            z = zeros[i]
            one = zeros[i + 1] == z
            c |= one.astype(np.int64) << bit
            i = np.where(one, total + i - z, z)
        return self.first[c] + i - self.base[c]

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, position) of all occurrences of the right-aligned rows of words."""
        width = words.shape[1]
        known = len(self.first) - 1
        which = np.flatnonzero((np.where(np.arange(width) >= width - length[:, None], words, 1) < known).all(axis=1))
        lo, hi = np.zeros(len(which), dtype=np.int64), np.full(len(which), self.n, dtype=np.int64)
        for k in range(width):
            on = np.flatnonzero(length[which] > k)
            c = words[which[on], width - 1 - k]
            lo[on] = self.first[c] + self.rank(c, lo[on])
            hi[on] = self.first[c] + self.rank(c, hi[on])
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        count = hi - lo
        found = np.repeat(which, count)
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        at = np.zeros(len(row), dtype=np.int64)
        walk = np.arange(len(row))
        steps = 0
        while len(walk):
            done = self.marked[row[walk]]
            at[walk[done]] = self.samples[self.marks[row[walk[done]]]] + steps
            walk = walk[~done]
            row[walk] = self.step(row[walk])
            steps += 1
        return found, at


def _scan(shared, carried: int, later: bool = False):
    """The findings of a block; of a later one with those of earlier blocks, the last two columns (word_spans, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        for batch, chunk in chunks(batches):
            starts, ends, of = chunk.words(ALNUM_WORDS)
            n_words = np.bincount(of, minlength=chunk.n)
            first = np.concatenate([[0], np.cumsum(n_words)])
            through = slice(carried, -2 if later else None)
            hit = np.zeros(len(starts) + 1, dtype=np.int64)
            pairs = np.zeros((0, 2), dtype=np.int64)
            if len(w.length) and len(starts):
                number = w.numbers(chunk.hashes(starts, ends, lower=True))
                # runs of known words within a text
                known = number > 0
                opens = known & np.concatenate([[True], ~known[:-1] | (of[1:] != of[:-1])])
                run_of = np.cumsum(opens) - 1
                size = np.bincount(run_of[known], minlength=int(opens.sum()) or 1)
                keep = np.flatnonzero(known)
                keep = keep[size[run_of[keep]] >= w.shortest]
                if len(keep):
                    ends_run = np.flatnonzero(np.concatenate([run_of[keep][1:] != run_of[keep][:-1], [True]]))
                    place = np.arange(len(keep)) + np.searchsorted(ends_run, np.arange(len(keep)))
                    seq = np.zeros(len(keep) + len(ends_run), dtype=np.int64)
                    seq[place] = number[keep]
                    word = np.zeros(len(seq), dtype=np.int64)
                    word[place] = keep
                    found, at = FMIndex(seq).search(w.words, w.length)
                    at = word[at]
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + w.length[found], -1)
                    count = w.item_at[found + 1] - w.item_at[found]
                    item = np.repeat(w.item_at[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                    if len(item):
                        pairs = np.unique(np.stack([np.repeat(of[at], count), w.item[item]], axis=1), axis=0)
            if later:
                spans_were, items_were = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
                base = np.repeat(first[:-1], np.asarray(spans_were.value_lengths()))
                was = spans_were.flatten()
                np.add.at(hit, base + np.asarray(was.field("start")), 1)
                np.add.at(hit, base + np.asarray(was.field("end")), -1)
                old = np.repeat(np.arange(chunk.n), np.asarray(items_were.value_lengths()))
                pairs = np.unique(np.concatenate([pairs, np.stack([old, np.asarray(items_were.flatten(), dtype=np.int64)], axis=1)]), axis=0)
            mark = np.cumsum(hit[:-1]) > 0
            n_hit = np.bincount(of[mark], minlength=chunk.n)
            edge = mark & np.concatenate([[True], ~mark[:-1] | (of[1:] != of[:-1])])[: len(mark)]
            last = mark & np.concatenate([~mark[1:] | (of[1:] != of[:-1]), [True]])[: len(mark)]
            a, b = np.flatnonzero(edge), np.flatnonzero(last)
            n_spans = np.concatenate([[0], np.cumsum(np.bincount(of[a], minlength=chunk.n))]).astype(np.int32)
            n_items = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=chunk.n))]).astype(np.int32)

            def spans(x: np.ndarray, y: np.ndarray) -> pa.Array:
                fields = [pa.array(z.astype(np.int32)) for z in (x, y)]
                return pa.ListArray.from_arrays(pa.array(n_spans), pa.StructArray.from_arrays(fields, ["start", "end"]))  # noqa: B023

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *batch.columns[through],
                    pa.array(n_words.astype(np.int64)),
                    pa.array(n_hit.astype(np.int64)),
                    spans(a - first[of[a]], b + 1 - first[of[b]]),
                    spans(starts[a] - chunk.offs[of[a]], ends[b] - chunk.offs[of[b]]),
                    pa.ListArray.from_arrays(pa.array(n_items), pa.array(pairs[:, 1])),
                ],
                ["doc_id", *batch.schema.names[through], "n_words", "n_hit", "word_spans", "byte_spans", "items"],
            )

    return run


def _pieces(benchmark: DataFrame, width: int, piece: int) -> DataFrame:
    """(item_id, text) of distinct runs of at most piece + width - 1 words, which overlap so that each window lies in one."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width), F.lit(piece))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i + 1, F.lit(piece + width - 1)), " "))
    return items.select("item_id", F.explode(cut).alias("text")).distinct()


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 8,
    block_bytes: int = 4 << 20,
    piece: int = 4096,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Return doc_id, the named columns of docs, n_words, n_hit, word_spans, byte_spans (merged, of the whole text) and items, one row per row of docs."""
    tune(spark)
    docs, names, carried = carrying(docs, F.col(id_col), text_col, columns)
    work = Work(spark, "blocks")
    items = work.write(_pieces(benchmark, width, piece), "pieces")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, ceil(total / block_bytes))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {names}n_words long, n_hit long, word_spans {SPAN}, byte_spans {SPAN}, items array<long>"
    every = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        windows = Windows([(r[0], r[1]) for r in block.collect()], width)  # at most about block_bytes
        shared = spark.sparkContext.broadcast(windows)
        if k == n_blocks - 1:
            return docs.mapInArrow(_scan(shared, carried, k > 0), schema)
        # written, so that a task holds one block's windows at a time
        found = docs.mapInArrow(_scan(shared, 1, k > 0), f"{every}, n_words long, n_hit long, word_spans {SPAN}, byte_spans {SPAN}, items array<long>")
        docs = work.write(found.drop("n_words", "n_hit", "byte_spans"), f"block-{k}")
        shared.unpersist()
        work.drop(f"block-{k - 1}")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans, which are sorted and disjoint."""
    data = F.encode(text, "UTF-8")
    before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    after = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    pieces = F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p: F.decode(F.substring(data, p["a"] + 1, p["b"] - p["a"]), "UTF-8"))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 8 THEN list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k:k+7], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g, least(len(ws), 8) AS n FROM i),
l AS (SELECT DISTINCT n FROM w),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, l),
g AS (SELECT doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') AS g FROM p),
h AS (SELECT g.doc_id, g.k, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.g = w.g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.ws), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
