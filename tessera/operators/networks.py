"""Sorting inside a row's array by fixed networks and by merging, in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def bitonic_sort(values: Column, n: int) -> Column:
    """Ascending order of an array of n elements (a power of two) without nulls: log2(n)
    squared stages, in each of which every place meets its partner."""
    if n & n - 1:
        raise ValueError("a power of two of elements")
    width = 2
    while width <= n:
        reach = width // 2
        while reach:
            values = _let(values, _stage(width, reach))
            reach //= 2
        width *= 2
    return values


def _stage(width: int, reach: int):
    return lambda a: F.transform(a, lambda v, i: _exchange(a, v, i, width, reach))


def _merging(width: int):
    return lambda a: _merged(a, width)


def _exchange(a: Column, v: Column, i: Column, width: int, reach: int) -> Column:
    other = F.get(a, i.bitwiseXOR(F.lit(reach)))
    lower, up = i.bitwiseAND(F.lit(reach)) == 0, i.bitwiseAND(F.lit(width)) == 0
    return F.when(lower == up, F.least(v, other)).otherwise(F.greatest(v, other))


def merge_sort(values: Column, n: int) -> Column:
    """Ascending order by merging sorted pieces of doubled length: an element's place is its
    own in its piece and the number of elements before it in the piece beside."""
    width = 1
    while width < n:
        values = _let(values, _merging(width))
        width *= 2
    return values


def _merged(a: Column, width: int) -> Column:
    def place(v: Column, i: Column) -> Column:
        first = (i - F.pmod(i, F.lit(2 * width))).cast("int")
        left = F.pmod(i, F.lit(2 * width)) < width
        other = F.slice(a, F.when(left, first + width + 1).otherwise(first + 1), F.lit(width))
        # of equals the left piece's come first
        before = F.size(F.filter(other, lambda o: F.when(left, o < v).otherwise(o <= v)))
        return F.struct((first + F.pmod(i, F.lit(width)) + before).cast("int").alias("p"), v.alias("v"))

    return F.transform(F.array_sort(F.transform(a, place)), lambda s: s["v"])
