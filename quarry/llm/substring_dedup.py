"""Suffix-array deduplication of long substrings by distributed prefix doubling.

The aim: find every ``length``-byte string that also starts in a text of smaller
id, and remove the bytes that such strings cover. Ranks of the prefixes of
positions are doubled until the prefix is unique or reaches ``length``:

* Inside a chunk of texts ranks are fingerprints, doubled at offsets 1, 2, 4, 8, ... up
  to the seed length k = length // 2 + 1: rank(p, 2j) = mix(rank(p, j), rank(p + j, j)).
* Only some positions take part in what Spark sorts. Each window of
  ``length - k + 1`` consecutive k-byte prefixes nominates the one of smallest
  rank, the leftmost of equals. The choice depends on the window's bytes alone,
  so equal ``length``-byte strings nominate the same position within them, and
  no string is missed. About 1 in 13 positions is nominated.
* Round 1: Spark deals the ranks of nominated positions by rank; each partition
  sorts its ranks. Positions whose prefix lies in one text only are dropped.
* Round 2: each position left comes with the bytes up to the threshold on either
  side. Spark deals them by the rank of the prefix; each partition reranks the
  extensions of every prefix to the left and to the right, by sorting their bytes,
  and a string is the pair of the ranks of its two sides. Equal neighbourhoods are
  one entry that keeps the smallest id, so a group of near copies is reduced before
  its strings are told apart. Past the threshold, what remains is, for each of the
  ``length``-byte strings around a position, the smallest id that has it.
* A seed in more than ``hot_texts`` texts would bring a position of each of them into
  one task. Its strings are dealt one by one instead, by their own fingerprints, after
  each part of the texts has reduced them to the smallest id; the parts learn which of
  their strings others have with a smaller id, and mark them themselves.
* Texts with equal content count once in these rounds: of n exact copies only
  the one of smallest id is compared, in one row; the others are covered wholly.

``every_position`` is the method without nomination: Spark sorts a pair of ranks for
each byte in each of seven rounds. The tests hold both against brute force; README has
what each of them costs.

What travels in both rounds is packed: a row holds the sorted numbers of one part of
the texts for one bucket of the ranks. There are as many parts as buckets, and both
grow with the square root of the input, so the rows of every step are about one for
``row_bytes`` bytes of text at any size, as is the number of bytes of a part, which is
the geometric mean of the input's and ``row_bytes``.

Rank collisions: round 1 compares 40 bits, where a chance hit only costs work. Round 2
compares bytes. Strings of seeds in more than ``hot_texts`` texts are equal if 64 bits
agree; two different ones are taken for one with a chance of 2 ** -64 a pair.

Edge cases: null and empty texts have no bytes. Texts shorter than ``length``
are kept whole. Repeats within one text are not removed. Rows that repeat an id
are one document, with one text or several: none of them covers another, and each
loses what its own text shares with smaller ids. Rows without an id come after all
others and count as one document as well. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, U64, Chunk, Work, chunks, mix, partitions, table

LOW40 = U64((1 << 40) - 1)
TEXT_BYTES = 1 << 18  # of a chunk: numpy's arrays are then about 2 MB each and stay in the cache
HELD = 64 << 20  # bytes of seeds that a task holds, to deal them in larger rows
NEVER = np.iinfo(np.int64).max


def ranks(buf: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint of the k bytes from each position of buf, by prefix doubling."""
    r, j = BYTE_CODE[buf], 1
    while j < k and len(r):
        step = min(j, k - j)
        if len(r) <= step:
            return r[:0]
        new = r[: len(r) - step] * U64(0x9E3779B97F4A7C15)
        new += r[step:]
        new ^= new >> U64(32)
        r = new
        j += step
    return mix(r)


def nominated(r: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Of each valid window of w ranks the place of the smallest; distinct, in order.

    Ranks are compared by their upper half, equal ones by place, the leftmost first:
    a rule that depends on the window alone.
    """
    if len(r) < w:
        return np.zeros(0, np.int64)
    least = r & U64(0xFFFFFFFF00000000)
    least |= np.arange(len(r), dtype=np.uint64)
    span = 1
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    at = (least[valid[: len(least)]] & U64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]


def _seeds(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in buf, rank) of the nominated positions of each text."""
    k = length // 2 + 1
    r = ranks(chunk.buf, k)
    # windows that begin so many bytes before the end of their text lie in it
    left = np.repeat(chunk.offs[1:], np.diff(chunk.offs)) - np.arange(len(chunk.buf))
    at = nominated(r, length - k + 1, left >= length)
    return np.searchsorted(chunk.offs, at, "right") - 1, at, r[at]


def _low5(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from5(data: bytes) -> np.ndarray:
    five = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _bucket(rank: np.ndarray, n: int) -> np.ndarray:
    return ((rank >> U64(40)) % U64(n)).astype(np.int64)


def _groups(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(x):
        edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


_SEEDS = {"bucket": pa.int32(), "ids": pa.binary(), "parts": pa.binary(), "seeds": pa.binary(), "of": pa.binary()}
_SHARED = {"part": pa.int32(), "bucket": pa.int32(), "hot": pa.bool_(), "seeds": pa.binary()}
_PAIRS = {"bucket": pa.int32(), "kind": pa.int32(), "part": pa.int32(), "data": pa.binary()}
_FOUND = {"part": pa.int32(), "kind": pa.int32(), "data": pa.binary()}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{c} {names[t]}" for c, t in schema.items())


def _emit_seeds(length: int, n: int):
    """One row a bucket for the distinct ranks of each text, of as many texts as ``HELD`` allows."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        done = np.cumsum([0, *(len(h[0]) for h in held)])
        ids, parts, rank = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
        of = np.concatenate([h[2] + d for h, d in zip(held, done, strict=False)])
        bucket, rank = _bucket(rank, n), rank & LOW40
        order = np.lexsort((of, rank, bucket))
        of, rank, bucket = of[order], rank[order], bucket[order]
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])])[: len(of)]
        of, rank, bucket = of[new], rank[new], bucket[new]
        rows = []
        for a, b in _groups(bucket):
            texts, local = np.unique(of[a:b], return_inverse=True)
            rows.append((int(bucket[a]), ids[texts].tobytes(), parts[texts].tobytes(), _low5(rank[a:b]).tobytes(), local.astype(np.uint32).tobytes()))
        return _batch(_SEEDS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, chunk in chunks(batches, most=TEXT_BYTES):
            of, _, rank = _seeds(chunk, length)
            held.append((np.asarray(batch.column(0), dtype=np.int64), np.asarray(batch.column(2), dtype=np.int32), of, rank))
            size += 16 * len(rank) + 12 * chunk.n
            if size >= HELD:
                yield settle(held)
                held, size = [], 0
        if held:
            yield settle(held)

    return run


def _shared_seeds(hot: int):
    """Rows (part, bucket, hot, seeds): ranks that lie in two texts or more, for each part of the texts that has them.

    Those in more than ``hot`` texts come in rows of their own. Reads one bucket after
    another: rows come sorted by bucket.
    """

    def settle(bucket: int, rows: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
        seed = np.concatenate([_from5(s) for _, _, s, _ in rows])
        local = [np.frombuffer(o, np.uint32) for *_, o in rows]
        ids = np.concatenate([np.frombuffer(i, np.int64)[o] for (i, *_), o in zip(rows, local, strict=True)])
        part = np.concatenate([np.frombuffer(s, np.int32)[o] for (_, s, *_), o in zip(rows, local, strict=True)])
        order = np.argsort(seed, kind="stable")
        seed, ids, part = seed[order], ids[order], part[order]
        start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        size = np.diff(np.append(start, len(seed)))
        several = np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start)
        keep = np.repeat(several, size)
        many = np.repeat(size > hot, size)[keep].astype(np.int64)
        seed, part = seed[keep], part[keep].astype(np.int64)
        order = np.lexsort((seed, many, part))
        seed, row = seed[order], (part * 2 + many)[order]
        new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])])[: len(seed)]
        seed, row = seed[new], row[new]
        return _batch(_SHARED, [(int(row[a]) // 2, bucket, bool(row[a] % 2), _low5(seed[a:b]).tobytes()) for a, b in _groups(row)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at and rows:
                    yield settle(at, rows)
                    rows = []
                at = b
                rows.append(tuple(row))
        if rows:
            yield settle(at, rows)

    return run


def _site(length: int) -> np.dtype:
    """A nominated position: its text by number in its part, its place, how many bytes of the text lie on either side of
    the seed, up to the threshold, and those bytes: the left ones reversed, the seed, the right ones."""
    side = length - length // 2 - 1
    return np.dtype([("id", "<i8"), ("text", "<u4"), ("at", "<u4"), ("left", "<u2"), ("right", "<u2"), ("around", "u1", (length + side,))])


def _in_order(texts: pa.Table) -> pa.Table:
    """The texts of a part in an order that every step finds again."""
    return texts.take(pc.sort_indices(texts, sort_keys=[("id", "ascending"), ("key", "ascending")]))


def _sites(texts: pa.Table, seeds: list[tuple[int, bytes]], length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nominated positions of a part's texts whose seed is among the given ones, and their ranks."""
    k = length // 2 + 1
    side = length - k
    out, ranks_, done = [np.zeros(0, _site(length))], [np.zeros(0, np.uint64)], 0
    known = np.unique(np.concatenate([_from5(s) * U64(n) + U64(b) for b, s in seeds])) if seeds else np.zeros(0, np.uint64)
    for batch, chunk in chunks(iter(texts.select(["id", "text"]).to_batches(max_chunksize=2000) if len(known) else []), most=TEXT_BYTES):
        of, at, rank = _seeds(chunk, length)
        full = (rank & LOW40) * U64(n) + _bucket(rank, n).astype(np.uint64)
        keep = known[np.minimum(np.searchsorted(known, full), len(known) - 1)] == full
        of, at, rank = of[keep], at[keep], rank[keep]
        x = np.zeros(len(at), _site(length))
        x["id"], x["text"], x["at"] = np.asarray(batch.column(0), dtype=np.int64)[of], of + done, at - chunk.offs[of]
        x["left"] = np.minimum(side, at - chunk.offs[of])
        x["right"] = np.minimum(side, chunk.offs[of + 1] - at - k)
        wide = np.concatenate([np.zeros(side, np.uint8), chunk.buf, np.zeros(side, np.uint8)])
        before = wide[(at + side - 1)[:, None] - np.arange(side)]
        after = wide[(at + side)[:, None] + np.arange(k + side)]
        before[np.arange(side) >= x["left"][:, None]] = 0
        after[:, k:][np.arange(side) >= x["right"][:, None]] = 0
        x["around"][:, :side], x["around"][:, side:] = before, after
        out.append(x)
        ranks_.append(rank)
        done += chunk.n
    return np.concatenate(out), np.concatenate(ranks_)


def _fits(x: np.ndarray, side: int) -> np.ndarray:
    """Which of the strings from 0, 1, ... bytes before a position lie in its text."""
    o = np.arange(side + 1)
    return (x["left"][:, None] >= o) & (x["right"][:, None] >= side - o)


def _string_keys(rank: np.ndarray, x: np.ndarray, side: int) -> np.ndarray:
    """Of each position the fingerprints of the strings from 0, 1, ... bytes before it.

    Ranks of the prefixes of either side are doubled up byte by byte; a string's pairs
    the rank of what lies before the seed with that of what lies behind it.
    """
    sides = x["around"][:, :side], x["around"][:, -side:] if side else x["around"][:, :0]
    pre = np.zeros((2, len(rank), side + 1), np.uint64)
    for s, around in enumerate(sides):
        pre[s, :, 0] = h = mix(rank + U64(s))
        for j in range(side):
            h = mix(h * U64(0x9E3779B97F4A7C15) + BYTE_CODE[around[:, j]])
            pre[s, :, j + 1] = h
    return mix(pre[0] * U64(0xD6E8FEB86659FD93) + pre[1][:, ::-1] + np.arange(side + 1).astype(np.uint64))


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the smallest id of each."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    return keys[new], ids[new]


def _as_words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of numbers whose order, the last column first, is that of the rows of bytes."""
    wide = np.zeros((len(rows), rows.shape[1] + -rows.shape[1] % 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return [c.astype(np.uint64) for c in wide.view(">u8").T[::-1]]


def _reranked(seed: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For 0, 1, ... bytes of a side, ranks of the seed followed by those bytes: equal for equal bytes only."""
    rows = np.concatenate([seed, side], axis=1)
    order = np.lexsort(_as_words(rows))
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])  # the first byte that differs from the row before
    out = np.zeros((len(rows), side.shape[1] + 1), np.int64)
    out[order[1:]] = np.cumsum(first[:, None] < seed.shape[1] + np.arange(side.shape[1] + 1), axis=0)
    return out


def _emit_pairs(length: int, n: int):
    """For one part of the texts: rows (bucket, kind, part, data).

    Kind 0: the nominated positions whose seed is shared.
    Kind 1: of seeds in very many texts the strings around a position, one entry a string
    with the smallest id of the part, dealt by string.
    Kind 2: those positions themselves, and their ranks, on their way to the last step.
    """
    side = length - length // 2 - 1

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, seeds: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), list(zip(*(seeds.column(c).to_pylist() for c in ("bucket", "hot", "seeds")), strict=True))
        x, rank = _sites(_in_order(texts), [(b, s) for b, _, s in rows], length, n)
        bucket = _bucket(rank, n)
        known = [_from5(s) * U64(n) + U64(b) for b, h, s in rows if h]
        hot = np.isin((rank & LOW40) * U64(n) + bucket.astype(np.uint64), np.concatenate(known)) if known else np.zeros(len(rank), bool)
        out = []
        order = np.flatnonzero(~hot)
        order = order[np.lexsort((rank[order], bucket[order]))]  # equal neighbourhoods side by side, which packs them better
        for a, b in _groups(bucket[order]):
            out.append((int(bucket[order[a]]), 0, part, x[order[a:b]].tobytes()))
        if hot.any():
            x, rank = x[hot], rank[hot]
            out.append((part % n, 2, part, x.tobytes() + rank.tobytes()))
            fits = _fits(x, side)
            keys, ids = _least(_string_keys(rank, x, side)[fits], np.broadcast_to(x["id"][:, None], fits.shape)[fits])
            bucket = (keys % U64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            numbers = np.stack([keys.view(np.int64), ids], axis=1)[order]
            for a, b in _groups(bucket[order]):
                out.append((int(bucket[order[a]]), 1, part, numbers[a:b].tobytes()))
        return pa.Table.from_batches([_batch(_PAIRS, out)])

    return run


def _covered(length: int):
    """Rows (part, kind, data), bucket by bucket, one a part.

    Kind 0: what texts share with texts of smaller id, as (text, start, end), merged within the bucket.
    Kind 1: the strings of a part, from very frequent seeds, that another part has with a smaller id.
    Kind 2: the positions of such seeds as they came.
    """
    k = length // 2 + 1
    side = length - k

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        each = [np.frombuffer(d, _site(length)) for _, d in rows]
        x, part = np.concatenate(each), np.repeat(np.array([p for p, _ in rows], np.int64), [len(e) for e in each])
        reach = x["left"].astype(np.uint64) << U64(16) | x["right"]
        words = _as_words(x["around"])
        mixed = mix(reach)
        for w in words:
            mixed = mix(mixed * U64(0x9E3779B97F4A7C15) + w)
        # equal neighbourhoods are one entry: its smallest id stands for all
        order = np.lexsort((x["id"], mixed))
        same = (mixed[order[1:]] == mixed[order[:-1]]) & (reach[order[1:]] == reach[order[:-1]])
        for w in words:
            same &= w[order[1:]] == w[order[:-1]]
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        first = x[order[start]]  # of each entry, a position with the smallest id
        least = np.where(_fits(first, side), first["id"][:, None], NEVER)
        # an entry alone with its seed has unique strings: its smallest id is all there is to know
        seed = first["around"][:, side : side + k]
        order = np.lexsort(_as_words(seed))
        again = (seed[order[1:]] == seed[order[:-1]]).all(axis=1)
        several = np.zeros(len(first), bool)
        several[order[1:][again]] = several[order[:-1][again]] = True
        several = np.flatnonzero(several)
        if len(several):
            sub = first[several]
            left, right = (_reranked(sub["around"][:, side : side + k], s) for s in (sub["around"][:, :side], sub["around"][:, side + k :]))
            fits = _fits(sub, side)
            for o in range(side + 1):
                on = np.flatnonzero(fits[:, o])
                if len(on):
                    distinct, inverse = np.unique(left[on, o] * (len(sub) + 1) + right[on, side - o], return_inverse=True)
                    best = np.full(len(distinct), NEVER)
                    np.minimum.at(best, inverse, sub["id"][on])
                    least[several[on], o] = best[inverse]
        hit = least[entry] < x["id"][:, None]
        of, a, b = _merged(*_as_spans(hit, part << 32 | x["text"].astype(np.int64), x["at"].astype(np.int64), length))
        found = np.stack([of & 0xFFFFFFFF, a, b], axis=1).astype("<u4")
        return _batch(_FOUND, [(int(of[i]) >> 32, 0, found[i:j].tobytes()) for i, j in _groups(of >> 32)])

    def beaten(rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.frombuffer(d, np.int64).reshape(-1, 2) for _, d in rows]
        keys, least = _least(np.concatenate([p[:, 0] for p in parts]).view(np.uint64), np.concatenate([p[:, 1] for p in parts]))
        out = [p[least[np.searchsorted(keys, p[:, 0].view(np.uint64))] < p[:, 1], 0].tobytes() for p in parts]
        return _batch(_FOUND, [(part, 1, lost) for (part, _), lost in zip(rows, out, strict=True) if lost])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for bucket, kind, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 2:
                    yield _batch(_FOUND, [(part, 2, data)])
                    continue
                if (bucket, kind) != at and rows:
                    yield (beaten if at[1] else spans)(rows)
                    rows = []
                at = bucket, kind
                rows.append((part, data))
        if rows:
            yield (beaten if at[1] else spans)(rows)

    return run


def _as_spans(hit: np.ndarray, of: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the strings that are hit: those from o bytes before a position cover [at - o, at - o + length)."""
    some = np.flatnonzero(hit.any(axis=1))
    h = np.zeros((len(some), hit.shape[1] + 2), bool)
    h[:, 1:-1] = hit[some]
    row, a = np.nonzero(h[:, 1:] & ~h[:, :-1])  # runs of offsets are one span
    _, b = np.nonzero(~h[:, 1:] & h[:, :-1])
    pos = some[row]
    return of[pos], at[pos] - (b - 1), at[pos] - a + length


def _merged(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its spans in order, those that overlap or touch joined."""
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    text = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]]))[: len(of)].astype(np.int64)
    big = np.int64(1) << np.int64(40)
    reach = np.maximum.accumulate(text * big + end) if len(of) else end
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (text[1:] * big + start[1:] > reach[:-1])])[: len(of)]
    at = np.flatnonzero(new)
    if not len(at):
        return of[:0], start[:0], end[:0]
    return of[at], start[at], (reach - text * big)[np.append(at[1:], len(of)) - 1]


def _finish(length: int, n: int, with_text: bool):
    """For one part of the texts: the result of each."""
    side = length - length // 2 - 1

    def frequent(data: list[bytes], beaten: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans from seeds in very many texts: strings of which this part, or another, has a smaller id."""
        m = [len(d) // (_site(length).itemsize + 8) for d in data]
        x = np.concatenate([np.frombuffer(d, _site(length), c) for d, c in zip(data, m, strict=True)])
        rank = np.concatenate([np.frombuffer(d, np.uint64, c, c * _site(length).itemsize) for d, c in zip(data, m, strict=True)])
        keys, fits = _string_keys(rank, x, side), _fits(x, side)
        known, least = _least(keys[fits], np.broadcast_to(x["id"][:, None], fits.shape)[fits])
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = x["id"][:, None] > least[place]
        lost = np.sort(np.concatenate([np.frombuffer(b, np.int64) for b in beaten]).view(np.uint64)) if beaten else np.zeros(0, np.uint64)
        if len(lost):
            hit = hit | (lost[np.minimum(np.searchsorted(lost, keys), len(lost) - 1)] == keys)
        return _as_spans(hit & fits, x["text"].astype(np.int64), x["at"].astype(np.int64), length)

    names = {"doc_id": pa.int64(), "id": pa.int64(), "key": pa.int64(), "lead": pa.bool_(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), **({"kept": pa.binary()} if with_text else {})}

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, found: pa.Table) -> pa.Table:
        rows: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for kind, data in zip(found.column("kind").to_pylist(), found.column("data").to_pylist(), strict=True):
            rows[kind].append(data)
        plain = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(d, "<u4").reshape(-1, 3).astype(np.int64) for d in rows[0])])
        more = frequent(rows[2], rows[1]) if rows[2] else (plain[:0, 0],) * 3
        of, start, end = _merged(*(np.concatenate([plain[:, i], more[i]]) for i in range(3)))
        texts = _in_order(texts)
        first = np.searchsorted(of, np.arange(texts.num_rows + 1))
        out = []
        for i, (real, ident, text_key, lead, text) in enumerate(zip(*(texts.column(c).to_pylist() for c in ("doc_id", "id", "key", "lead", "text")), strict=True)):
            data, spans = text.encode(), slice(first[i], first[i + 1])
            cuts = [0, *np.stack([start[spans], end[spans]], axis=1).reshape(-1).tolist(), len(data)]
            kept = b"".join(data[cuts[j] : cuts[j + 1]] for j in range(0, len(cuts), 2))
            out.append((real, ident, text_key, lead, len(data), len(data) - len(kept), len(cuts) // 2 - 1, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return pa.Table.from_batches([_batch(names, out)])

    return run, _ddl(names)


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    row_bytes: int = 4096,
    hot_texts: int = 20_000,
    with_text: bool = False,
) -> DataFrame:
    """Return doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes), one row per row of docs.

    ``row_bytes`` is about the text behind one row that is dealt; a part of the texts, which one call
    holds, has the geometric mean of it and the bytes of all texts, but for texts longer than that.
    ``hot_texts`` is the number of texts with one seed from which its strings are dealt one by one.
    """
    work = Work(spark, "repeats")
    # null ids are last; rows of one id are one document
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NEVER - 1))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), ident.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(sqrt(total / row_bytes)))  # parts of the texts, and buckets of the ranks
    tasks = min(n, max(partitions(spark), ceil(total / (16 << 20))))
    docs = docs.withColumn("key", F.xxhash64("text"))
    # of texts that occur more than once, only rows of the smallest id are compared, and of equal ones of those one
    slim = docs.select("id", "key", F.xxhash64("text", F.lit(1)).alias("check"), F.octet_length("text").alias("size"))
    same = slim.groupBy("key", "check", "size").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = work.write(same, "same")
    # neither table has a bound: merged at every size, never broadcast
    several = slim.join(same.hint("merge"), ["key", "check", "size"]).select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), (F.col("id") > F.col("least")).alias("copy")).distinct()
    several = work.write(several, "several")
    marked = docs.join(several.hint("merge"), (F.col("id") == F.col("s_id")) & (F.col("key") == F.col("s_key")), "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.octet_length("text") >= length)
    marked = work.write(marked.select("doc_id", "id", "key", "copy", F.octet_length("text").cast("long").alias("n_bytes"), F.when(~gone, F.col("text")).alias("text")), "marked")
    work.drop("same", "several")
    first = marked.where("copy is null").select("doc_id", "id", "key", "text", F.lit(False).alias("lead"))
    leads = marked.where("not copy").select("doc_id", "id", "key", "text").dropDuplicates(["id", "key"]).withColumn("lead", F.lit(True))
    first = first.unionByName(leads).withColumn("part", F.pmod(F.xxhash64("id", "key"), F.lit(n)).cast("int"))

    seeds = first.select("id", "text", "part").mapInArrow(_emit_seeds(length, n), _ddl(_SEEDS)).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    shared = work.write(seeds.mapInArrow(_shared_seeds(hot_texts), _ddl(_SHARED)), "shared")
    pairs = first.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_emit_pairs(length, n), _ddl(_PAIRS))
    pairs = pairs.repartition(tasks, "bucket", "kind").sortWithinPartitions("bucket", "kind")
    found = work.write(pairs.mapInArrow(_covered(length), _ddl(_FOUND)), "found")
    work.drop("shared")
    finish, schema = _finish(length, n, with_text)
    done = work.write(first.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(finish, schema), "done")
    work.drop("found")
    names = ["n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    alone = done.where("not lead").select("doc_id", "n_bytes", *names)
    # rows that repeat an id and its text may be any number: merged, so that the join can split them
    leads = marked.where("not copy").select("doc_id", "id", "key", "n_bytes").join(done.where("lead").select("id", "key", *names).hint("merge"), ["id", "key"]).select("doc_id", "n_bytes", *names)
    whole, none = F.col("n_bytes") >= length, F.lit(0).cast("long")
    kept = F.coalesce("text", F.lit("")).cast("binary")
    copies = marked.where("copy").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(none).alias("n_removed"), F.when(whole, F.lit(1).cast("long")).otherwise(none).alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), *([kept.alias("kept")] if with_text else [])
    )
    return alone.unionByName(leads).unionByName(copies)


def every_position(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, pos): places from which ``length`` bytes also start in a text of smaller id; a rank for every position.

    Each round joins the ranks of positions with those ``step`` bytes on, sorts the pairs and numbers
    them in order; positions whose pair lies in one document only are dropped. Rows without an id,
    and without a text, take no part; ids are distinct.
    """
    work = Work(spark, "every")
    data = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_col, "UTF-8").alias("data"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1))
    here = data.where(F.octet_length("data") >= length).select("doc_id", "data", at.alias("pos"))
    here = work.write(here.select("doc_id", "pos", F.conv(F.hex(F.substr("data", F.col("pos") + 1, F.lit(1))), 16, 10).cast("long").alias("rank")), "rank-1")
    have = 1
    while have < length:
        step = min(have, length - have)
        there = here.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = work.write(here.select("doc_id", "pos", "rank").join(there, ["doc_id", "pos"]), f"pairs-{have}")
        ordered = pairs.groupBy("rank", "next").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        ordered = work.write(ordered.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id()), f"order-{have}")
        was, have = have, have + step
        here = work.write(pairs.join(ordered, ["rank", "next"]).select("doc_id", "pos", F.col("new").alias("rank"), "least"), f"rank-{have}")
        work.drop(f"rank-{was}", f"pairs-{was}", f"order-{was}")
    return here.where("doc_id > least").select("doc_id", "pos")


def op6_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"), length=50)


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS k, h FROM d WHERE length(h) >= 100),
g AS (SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, 100)) AS g FROM p),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT g.doc_id, g.k FROM g JOIN m USING (g) WHERE g.doc_id > m.least),
o AS (SELECT doc_id, k, max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
s AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM o),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM s GROUP BY doc_id, run),
x AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(x.n_removed, 0)::bigint AS n_removed, coalesce(x.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN x.doc_id IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda j:
    substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1, 2 * (CASE WHEN j = len(starts) THEN length(h) // 2 ELSE starts[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE ends[j] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
