"""Placement functions: hash, range and consistent-hash partitions, preference lists, salts."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_key(key: Column) -> Column:
    """The 160-bit hash of a key, as 40 hexadecimal digits."""
    return F.sha1(key.cast("string").cast("binary"))


def hash_partition(key: Column, n: int) -> Column:
    """The 160-bit hash modulo n, eight digits at a time: no step leaves 64 bits."""
    h, shift, out = hash_key(key), pow(16, 8, n), F.lit(0).cast("long")
    for i in range(5):
        part = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit(shift) + part, F.lit(n))
    return out.cast("int")


@dataclass(frozen=True)
class Ranges:
    """Partition i holds keys from bounds[i] up to, not including, bounds[i + 1]; all others go to the last."""

    bounds: tuple[str, ...]

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def partition(self, key: Column) -> Column:
        out = F.lit(self.n - 1)
        for i in range(self.n - 1, -1, -1):
            out = F.when((key >= self.bounds[i]) & (key < self.bounds[i + 1]), i).otherwise(out)
        return out

    def split(self, i: int, at: str) -> Ranges:
        if not self.bounds[i] < at < self.bounds[i + 1]:
            raise ValueError(f"{at!r} does not lie inside partition {i}")
        return Ranges((*self.bounds[: i + 1], at, *self.bounds[i + 1 :]))

    def merge(self, i: int, j: int) -> Ranges:
        if j != i + 1:
            raise ValueError("only neighbours can be merged")
        return Ranges((*self.bounds[:j], *self.bounds[j + 1 :]))


def _sha1(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


@dataclass(frozen=True)
class Ring:
    """A hash ring: nodes and their weights, in numbers of tokens."""

    nodes: tuple[tuple[str, int], ...]

    @property
    def tokens(self) -> list[tuple[str, str]]:
        return sorted((_sha1(f"{node}:{i}"), node) for node, weight in self.nodes for i in range(weight))

    def add(self, node: str, weight: int = 1) -> Ring:
        return Ring((*self.nodes, (node, weight)))

    def remove(self, node: str) -> Ring:
        return Ring(tuple(x for x in self.nodes if x[0] != node))

    def _next(self, h: Column) -> Column:
        """The place from 0 of the first token after h; hexadecimal digits of fixed width order like the numbers."""
        hashes = F.array(*(F.lit(t) for t, _ in self.tokens))
        return F.pmod(F.size(F.filter(hashes, lambda t: t <= h)), F.lit(len(self.tokens)))

    def partition(self, key: Column) -> Column:
        return self._next(hash_key(key))

    def owner(self, key: Column) -> Column:
        return F.get(F.array(*(F.lit(n) for _, n in self.tokens)), self.partition(key))

    def preference(self, key: Column, n: int) -> Column:
        """The next n distinct nodes clockwise from the hash of "key:0", which is another point than the partition's."""
        names = [node for _, node in self.tokens]
        at = self._next(hash_key(F.concat(key.cast("string"), F.lit(":0"))))
        clockwise = F.slice(F.array(*(F.lit(x) for x in names * 2)), at + 1, F.lit(len(names)))
        return F.slice(F.array_distinct(clockwise), 1, n)

    def owner_of(self, key: str) -> str:
        tokens = self.tokens
        return tokens[bisect_right([t for t, _ in tokens], _sha1(key)) % len(tokens)][1]

    def ranges(self, spark) -> DataFrame:
        """(partition, start, end, node): the hash interval of each token."""
        t = self.tokens
        rows = [(i, t[i - 1][0], t[i][0], t[i][1]) for i in range(len(t))]
        return spark.createDataFrame(rows, "partition int, start string, `end` string, node string")


def salt(key: Column, spread_by: Column, buckets: int) -> Column:
    """bucket#key: rows of one key dealt over buckets, the same for equal ``spread_by``."""
    return F.concat(F.pmod(F.xxhash64(spread_by), F.lit(buckets)).cast("string"), F.lit("#"), key.cast("string"))


def unsalt(key: Column) -> Column:
    return F.regexp_replace(key, "^[0-9]+#", "")
