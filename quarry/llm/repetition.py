"""Quality rules on repetition inside a text, from a suffix array over its words.

A chunk of texts is one sequence of words; suffixes are sorted by prefix
doubling, and only suffixes that still share their rank are sorted again, so a
text without repeats costs two or three rounds and one made of a single line
log2(words). Ranks of all rounds give the longest common prefix of neighbours in
the suffix array. The two neighbours of a suffix bound its deepest interval of
common prefixes, and so its longest repeat; it is maximal if the suffix one word
before doesn't extend it. The spans of repeats of at least ``min_words`` words are
joined; a text fails if they cover more than ``max_covered`` of its words or if
its longest repeat has more than ``max_longest`` words.

Memory: a text is judged whole, with 8 bytes a word for each doubling, of which there are as many as the
longest repeat has binary digits: a text of ten million words that is a single line over and over takes some 2 GB.

Edge cases: null, empty and blank texts have no words and fail the base rule on
length. Extra columns are ignored; repeated rows are each judged. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Chunk, byte_table, chunks, table, tune

_SYMBOL = ~byte_table(b"#*$%&|<>")
_LINE = byte_table([0x0A])
#: Bytes that begin a character.
_STARTS = byte_table(range(0x80, 0xC0))


def longest_repeats(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each word the length of the longest string of words from it that its text has twice."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(of, of, "right")  # of each word's text
    order = np.lexsort((h, of))
    new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels = [rank]
    size = np.diff(np.append(at, n))
    open_ = order[np.repeat(size > 1, size)]  # positions that share their rank, in order of it
    k = 1
    while len(open_):
        follow = np.where(open_ + k < end[open_], rank[np.minimum(open_ + k, n - 1)], -1)
        old = rank[open_]
        by = np.lexsort((follow, old))
        open_, old, follow = open_[by], old[by], follow[by]
        first_old = np.concatenate([[True], old[1:] != old[:-1]])
        first = first_old | np.concatenate([[True], follow[1:] != follow[:-1]])
        place = np.arange(len(open_))
        block = np.maximum.accumulate(np.where(first_old, place, 0))
        group = np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[open_] = old + group - block
        levels.append(rank)
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n + 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    x, y = a[live].copy(), b[live].copy()
    got = np.zeros(len(live), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((x < end[a[live]]) & (y < end[b[live]]))
        ok = ok[levels[j][x[ok]] == levels[j][y[ok]]]
        x[ok] += 1 << j
        y[ok] += 1 << j
        got[ok] += 1 << j
    lcp[live + 1] = got
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:])
    return out


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:-1]) > 0


def _rules(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches):
            starts, ends, of = chunk.words(SPACE_WORDS)
            n = len(starts)
            of_text = lambda mask: np.bincount(of[mask], minlength=chunk.n).astype(np.int64)  # noqa: B023, E731
            n_words = np.bincount(of, minlength=chunk.n).astype(np.int64)
            begun = np.concatenate([[0], np.cumsum(_STARTS[chunk.buf] & SPACE_WORDS[chunk.buf])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[chunk.buf])])
            ls, le, lof = chunk.words(_LINE)
            before = np.concatenate([[0], np.cumsum(SPACE_WORDS[chunk.buf])])
            worded = before[le] > before[ls]
            ls, le, lof = ls[worded], le[worded], lof[worded]
            lh = chunk.hashes(ls, le)
            order = np.lexsort((lh, lof))
            again = (lh[order[1:]] == lh[order[:-1]]) & (lof[order[1:]] == lof[order[:-1]])
            n_dup = np.bincount(lof[order[1:][again]], minlength=chunk.n).astype(np.int64)
            repeat = longest_repeats(chunk.hashes(starts, ends), of)
            windows = np.flatnonzero(repeat >= 3)
            n_repeat = of_text(_covered(windows, np.full(len(windows), 3), n))
            long = repeat >= min_words
            extends = np.concatenate([[False], (repeat[:-1] > repeat[1:]) & (of[:-1] == of[1:])])[:n]
            maximal = np.flatnonzero(long & ~extends)
            n_covered = of_text(_covered(maximal, repeat[maximal], n))
            longest = np.zeros(chunk.n, np.int64)
            np.maximum.at(longest, of, repeat)
            edge = chunk.offs
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(
                        pa.array(np.asarray(c, dtype=np.int64))
                        for c in (n_words, begun[edge[1:]] - begun[edge[:-1]], symbols[edge[1:]] - symbols[edge[:-1]], n_dup, n_repeat, n_covered, longest, np.bincount(of[maximal], minlength=chunk.n))
                    ),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_maximal"],
            )

    return run


def repetition_rules(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 8,
    max_covered: float = 0.4,
    max_longest: int = 60,
) -> DataFrame:
    """Return doc_id, the base counts, n_covered_words, longest_repeat, n_maximal (repeats), base_failed and kept."""
    tune(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "n_maximal")
    out = docs.mapInArrow(_rules(min_words), "doc_id long, " + ", ".join(f"{c} long" for c in names))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeats = (F.col("n_covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~repeats)


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark, table(spark, sf_dir, "documents"))
