"""Boundary conditions: bounded arrays made total by remapping coordinates.

Each takes an array and a larger region and joins the region's points to the array on
remapped coordinates; only the coordinate expressions differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.region import Box, box
from .table import ArrayTable, domain


def edge(x: Column, lo: int, w: int) -> Column:
    return F.greatest(F.least(x, F.lit(lo + w - 1)), F.lit(lo))


def wrapped(x: Column, lo: int, w: int) -> Column:
    return F.lit(lo) + F.pmod(x - lo, F.lit(w))


def mirrored(x: Column, lo: int, w: int) -> Column:
    """The edge comes twice."""
    m = F.pmod(x - lo, F.lit(2 * w))
    return F.lit(lo) + F.when(m >= w, 2 * w - 1 - m).otherwise(m)


def mirrored_inside(x: Column, lo: int, w: int) -> Column:
    """The edge comes once."""
    if w == 1:
        return F.lit(lo) + F.lit(0) * x
    return F.lit(lo + w - 1) - F.abs(F.pmod(x - lo, F.lit(2 * (w - 1))) - (w - 1))


def remapped(a: ArrayTable, region, f: Callable[[Column, int, int], Column], bounds: Box | None = None) -> ArrayTable:
    """``bounds`` may cover the first dimensions only; the others are not remapped."""
    r, own = box(*region), bounds or a.region
    points = domain(a.df.sparkSession, list(a.dims), r)
    key = [f"_k{i}" for i in range(len(a.dims))]
    points = points.select("*", *[(f(F.col(d), own[i].min, own[i].extent) if i < len(own) else F.col(d)).cast("int").alias(k) for i, (d, k) in enumerate(zip(a.dims, key))])
    src = a.df.select(*[F.col(d).alias(k) for d, k in zip(a.dims, key)], *a.values)
    return ArrayTable(points.join(src, key).select(*a.dims, *a.values), a.dims, a.values, a.types, r)


def repeat_edge(a: ArrayTable, region, bounds: Box | None = None) -> ArrayTable:
    return remapped(a, region, edge, bounds)


def repeat_image(a: ArrayTable, region, bounds: Box | None = None) -> ArrayTable:
    return remapped(a, region, wrapped, bounds)


def mirror_image(a: ArrayTable, region, bounds: Box | None = None) -> ArrayTable:
    return remapped(a, region, mirrored, bounds)


def mirror_interior(a: ArrayTable, region, bounds: Box | None = None) -> ArrayTable:
    return remapped(a, region, mirrored_inside, bounds)


def constant_exterior(a: ArrayTable, value, region, bounds: Box | None = None) -> ArrayTable:
    """``value`` (one, or one a value column) outside the bounds."""
    r, own = box(*region), bounds or a.region
    src = a.df
    for d, b in zip(a.dims, own):
        src = src.where(F.col(d).between(b.min, b.max))
    points = domain(a.df.sparkSession, list(a.dims), r)
    fill = value if isinstance(value, tuple) else (value,) * len(a.values)
    out = points.join(src.select(*a.dims, *a.values), list(a.dims), "left")
    return ArrayTable(out.select(*a.dims, *[F.coalesce(F.col(v), F.lit(x).cast(t.spark)).alias(v) for v, x, t in zip(a.values, fill, a.types)]), a.dims, a.values, a.types, r)
