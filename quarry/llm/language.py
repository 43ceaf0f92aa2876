"""Language identification with averaged hashed subword embeddings.

Features are the byte 2-, 3- and 4-grams of a text, white space and ASCII
punctuation folded to one space and A-Z to a-z, hashed to ``buckets`` rows of an
embedding table. A text's vector is the average of its rows; a linear softmax on
top gives the language. Both layers are trained by stochastic gradient descent in
numpy, on the driver, on about ``sample`` labelled texts of at most
``sample_bytes`` bytes each, as many of every language and at least 20: a bounded sample, drawn by a hash of id and text,
so that it is the same for any partitioning. A language that has only longer texts is learned
from those. What executors receive is
the product of both layers, ``buckets`` rows of one number per language.

A fifth of the sample is left out of training: it fits the temperature that
calibrates the probabilities, and the rejection threshold, the probability that
all but ``reject`` of those texts reach, but one half at most: a text with a
language more likely than all others together is never rejected.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected. Texts of one byte have no feature and take the prior. Rows with a null
language are not learned from. If no row can be learned from, every text is
``und``. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Chunk, carrying, chunks, table, tune

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_LETTER = regex.compile(r"\p{L}")
_GRAMS = (2, 3, 4)


def _features(chunk: Chunk, buckets: int) -> Iterator[np.ndarray]:
    """For each n-gram length the bucket at each place of buf; ``buckets`` where no n-gram of one text begins."""
    b = _FOLD[chunk.buf].astype(np.uint32)
    left = np.repeat(chunk.offs[1:], np.diff(chunk.offs)) - np.arange(len(b))
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for n in _GRAMS:
        g = np.zeros(len(b), np.uint32)
        for j in range(n):
            g[: max(0, len(b) - j)] |= b[j:] << np.uint32(8 * j)
        g = (g ^ np.uint32(0x3C6EF372 + n)) * np.uint32(2654435761)
        g ^= g >> np.uint32(15)
        g *= np.uint32(2246822519)
        g = (g >> shift).astype(np.int64)
        g[left < n] = buckets
        yield g


def _bags(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in chunks(batches):
            grams = list(_features(chunk, buckets))
            rows, weights = [], []
            for a, b in zip(chunk.offs[:-1], chunk.offs[1:], strict=True):
                bag = np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=buckets + 1)[:buckets]
                on = np.flatnonzero(bag)
                rows.append(on.astype(np.uint16 if buckets <= 1 << 16 else np.uint32).tobytes())
                weights.append((bag[on] / max(1, bag.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array(weights, pa.binary())], ["lang", "rows", "weights"])

    return run


class Model:
    """languages, one number per bucket and language (a zero row last), bias, temperature and threshold."""

    def __init__(self, bags: list[tuple[str, np.ndarray, np.ndarray]], buckets: int, *, dim: int, epochs: int, rate: float, reject: float, seed: int, least_steps: int = 10_000):
        self.languages = sorted({lang for lang, _, _ in bags})
        rng = np.random.default_rng(seed)
        number = {lang: i for i, lang in enumerate(self.languages)}
        held = [b for i, b in enumerate(bags) if i % 5 == 4]
        used = [b for i, b in enumerate(bags) if i % 5 != 4]
        emb = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim)).astype(np.float32)
        out = np.zeros((dim, len(self.languages)), np.float32)
        bias = np.zeros(len(self.languages), np.float32)
        epochs = max(epochs, -(-least_steps // max(1, len(used))))  # a small sample is read more often
        steps, done = epochs * len(used), 0
        for _ in range(epochs):
            for i in rng.permutation(len(used)):
                lang, rows, weights = used[i]
                now = rate * (1 - done / steps)
                v = weights @ emb[rows]
                z = v @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[number[lang]] -= 1
                back = out @ p
                out -= now * np.outer(v, p)
                bias -= now * 0.01 * p
                # the average's gradient, with each row stepping as if it were the whole text
                emb[rows] -= (now * len(rows)) * np.outer(weights, back) / max(1.0, len(rows) ** 0.5)
                done += 1
        emb[buckets] = 0
        self.table = (emb @ out).astype(np.float32)
        self.bias = bias
        self.temperature, self.threshold = 1.0, 0.0
        if held:
            z = np.stack([w @ self.table[r] + self.bias for _, r, w in held])
            y = np.array([number[lang] for lang, _, _ in held])
            # labels smoothed by one part in the size of the fold: it can't prove more certainty than that
            sure = 1 - 1 / (len(y) + 2)
            goal = np.full(z.shape, (1 - sure) / max(1, z.shape[1] - 1))
            goal[np.arange(len(y)), y] = sure
            loss = {t: -(goal * np.log(self._softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in np.geomspace(0.05, 20, 60)}
            self.temperature = float(min(loss, key=loss.get))
            top = self._softmax(z / self.temperature).max(axis=1)
            self.threshold = float(min(0.5, np.quantile(top, reject)))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, chunk: Chunk, buckets: int) -> np.ndarray:
        total = np.zeros((chunk.n, len(self.languages)))
        count = np.zeros(chunk.n)
        some = np.flatnonzero(np.diff(chunk.offs))
        for g in _features(chunk, buckets):
            if len(some):
                total[some] += np.add.reduceat(self.table[g], chunk.offs[some], axis=0)
                count[some] += np.add.reduceat((g < buckets).astype(np.int64), chunk.offs[some])
        z = total / np.maximum(count, 1)[:, None] + self.bias
        return self._softmax(z / self.temperature)


def _predict(shared, buckets: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch, chunk in chunks(batches):
            lettered = np.array([t is not None and _LETTER.search(t) is not None for t in batch.column(1).to_pylist()], dtype=bool)
            if m is None:
                lang, score = np.full(chunk.n, "und", dtype=object), np.zeros(chunk.n)
                rejected = np.ones(chunk.n, bool)
            else:
                p = m.probabilities(chunk, buckets)
                lang = np.array(m.languages, dtype=object)[p.argmax(axis=1)]
                score = np.where(lettered, p.max(axis=1), 0.0)
                lang[~lettered] = "und"
                rejected = ~lettered | (score < m.threshold)
            found = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[carried:], *found], ["doc_id", *batch.schema.names[carried:], "lang_pred", "score", "rejected"])

    return run


def _sample(rows: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """(lang, text): as many texts of each language, at least 20, in an order by hash; rows that repeat an id and its text count once."""
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") >= 2))
    rows = rows.withColumns({"t": F.xxhash64("text"), "short": F.octet_length("text") <= sample_bytes})
    # one row a language
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("short"), F.struct("id", "t"))).alias("n"), F.approx_count_distinct(F.struct("id", "t")).alias("all")).collect()
    if not sizes:
        return rows.select("lang", "text").limit(0)
    size = max(20, sample // len(sizes))
    cut = {r["lang"]: int(min(1.0, (3 * size + 100) / max(1, r["n"] or r["all"])) * 1_000_003) for r in sizes}
    of = lambda values: F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang"))
    # about three times as many rows as are wanted are left, however large the table; equal ones of them are put together first
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.col("id").cast("string"), "t"), F.lit(1_000_003)))
    wanted = (F.col("h") <= of(cut)) & (F.col("short") | of({r["lang"]: r["n"] == 0 for r in sizes}))
    rows = rows.where(wanted).select("lang", "h", "id", "t", "text").dropDuplicates(["lang", "id", "t"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").select("lang", "text")


def predict_language(
    spark: SparkSession,
    docs: DataFrame,
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 2400,
    sample_bytes: int = 20_000,
    buckets: int = 1 << 15,
    dim: int = 16,
    epochs: int = 5,
    rate: float = 0.5,
    reject: float = 0.001,
    seed: int = 11,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Return doc_id, the named columns of docs, lang_pred, score and rejected, one row per row of docs, learned from the rows of labelled."""
    tune(spark)
    bags = [(r[0], np.frombuffer(r[1], np.uint16 if buckets <= 1 << 16 else np.uint32), np.frombuffer(r[2], np.float32)) for r in _sample(labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")), sample, sample_bytes).mapInArrow(_bags(buckets), "lang string, rows binary, weights binary").collect()]
    model = Model(bags, buckets, dim=dim, epochs=epochs, rate=rate, reject=reject, seed=seed) if bags else None
    del bags
    shared = spark.sparkContext.broadcast(model)
    docs, names, carried = carrying(docs, F.col(id_col).cast("long"), text_col, columns)
    return docs.mapInArrow(_predict(shared, buckets, carried), f"doc_id long, {names}lang_pred string, score double, rejected boolean")


def held_out(id_col: Column) -> Column:
    """Documents that the fixed fold keeps from training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_language(spark, docs, docs.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
