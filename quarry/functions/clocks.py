"""Vector clocks as map<string, bigint>, and Lamport clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(clock: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, node), F.lit(0))


def dominates(a: Column, b: Column) -> Column:
    """Whether a is later than b: greater somewhere, smaller nowhere.

    The two halves differ in form on purpose. Inside a lambda, where a and b are its
    variables, Spark takes f(a, b) and f(b, a) for the same expression, and would
    fold f(a, b) AND NOT f(b, a) to false.
    """
    greater = F.exists(F.map_keys(a), lambda k: _count(a, k) > _count(b, k))
    return greater & F.forall(F.map_keys(b), lambda k: _count(b, k) <= _count(a, k))


def compare(a: Column, b: Column) -> Column:
    """'>', '<' or null for equal and concurrent clocks."""
    return F.when(dominates(a, b), ">").when(dominates(b, a), "<")


def merge(a: Column, b: Column) -> Column:
    """The greater of each node's counters."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


class Lamport:
    def __init__(self, time: int = 0):
        self.time = time

    def tick(self) -> int:
        self.time += 1
        return self.time

    def update(self, received: int) -> int:
        self.time = max(self.time, received) + 1
        return self.time
