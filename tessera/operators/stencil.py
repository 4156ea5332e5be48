"""Stencils: fixed neighbourhoods of each point.

A neighbourhood is one shuffle however many taps it has: cells are dealt by tiles with
their edges copied to the neighbours; sums may also be sent to the points that read
them and added up on the way.  Results cover the points all of whose taps exist.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import I64, ElementType
from ..plans.region import Range
from . import halo
from .table import ArrayTable


def _shrunk(a: ArrayTable, offsets) -> tuple[Range, ...] | None:
    if a.region is None:
        return None
    out = []
    for i, r in enumerate(a.region):
        lo, hi = min(o[i] for o in offsets), max(o[i] for o in offsets)
        out.append(Range(r.min - lo, max(0, r.extent - (hi - lo))))
    return tuple(out)


def taps(a: ArrayTable, offsets: list[tuple[int, ...]], combine: Callable[[list[Column]], Column], type: ElementType = I64) -> ArrayTable:
    """v(p) = combine([a(p + o) for o in offsets]), where all of them exist, by one
    exchange of tiles (``halo``).  Where the point itself is not among the offsets, cells
    are sent to the points that read them instead."""
    names = [f"_t{k}" for k in range(len(offsets))]
    if (0,) * len(a.dims) in offsets:
        read = halo.gather(a.df.select(*a.dims), list(a.dims), [(a.df, a.values[0], [(o, f"_v{k}") for k, o in enumerate(offsets)])])
        got = read.where(reduce(lambda p, q: p & q, [F.col(f"_v{k}").isNotNull() for k in range(len(offsets))]))
        cols = [F.col(f"_v{k}") for k in range(len(offsets))]
    else:
        sent = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(d) - o).cast("int").alias(d) for d, o in zip(a.dims, off)]) for k, off in enumerate(offsets)])).alias("_t")
        spread = a.df.select(sent, F.col(a.values[0]).alias("_v")).select("_t.*", "_v")
        # each tap arrives at most once, so its maximum is itself; incomplete points go
        each = [F.max(F.when(F.col("k") == k, F.col("_v"))).alias(n) for k, n in enumerate(names)]
        got = spread.groupBy(*a.dims).agg(*each, F.count("*").alias("_n")).where(F.col("_n") == len(offsets))
        cols = [F.col(n) for n in names]
    out = got.select(*a.dims, combine(cols).cast(type.spark).alias("v"))
    return ArrayTable(out, a.dims, ("v",), (type,), _shrunk(a, offsets))


def correlate(a: ArrayTable, kernel: Mapping[tuple[int, ...], float], type: ElementType = I64, finish: Callable[[Column], Column] | None = None) -> ArrayTable:
    """v(p) = sum of weight * a(p + o): contributions are summed as they are grouped, so
    only one number a point leaves each task."""
    items = list(kernel.items())
    sent = F.explode(F.array(*[F.struct(*[(F.col(d) - o).cast("int").alias(d) for d, o in zip(a.dims, off)], F.lit(w).alias("w")) for off, w in items])).alias("_t")
    spread = a.df.select(sent, F.col(a.values[0]).alias("_v")).select("_t.*", "_v")
    got = spread.groupBy(*a.dims).agg(F.sum(F.col("_v") * F.col("w")).alias("s"), F.count("*").alias("_n")).where(F.col("_n") == len(items))
    s = finish(F.col("s")) if finish else F.col("s")
    return ArrayTable(got.select(*a.dims, s.cast(type.spark).alias("v")), a.dims, ("v",), (type,), _shrunk(a, list(kernel)))


def square(radius: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]


def box_blur3(a: ArrayTable) -> ArrayTable:
    """Two passes of (l + c + r) div 3 over the points to the right and below, as whole
    numbers."""
    third = lambda cs: F.floor((cs[0] + cs[1] + cs[2]) / 3)
    return taps(taps(a, [(0, 0), (1, 0), (2, 0)], third), [(0, 0), (0, 1), (0, 2)], third)


def sobel(a: ArrayTable) -> ArrayTable:
    """|gx| + |gy|, at most 255."""

    def combine(c: list[Column]) -> Column:
        at = dict(zip(square(1), c))
        gx = at[1, -1] + 2 * at[1, 0] + at[1, 1] - at[-1, -1] - 2 * at[-1, 0] - at[-1, 1]
        gy = at[-1, 1] + 2 * at[0, 1] + at[1, 1] - at[-1, -1] - 2 * at[0, -1] - at[1, -1]
        return F.least(F.abs(gx) + F.abs(gy), F.lit(255))

    return taps(a, square(1), combine)


def dilate3(a: ArrayTable) -> ArrayTable:
    return taps(a, square(1), lambda c: F.greatest(*c))


def erode3(a: ArrayTable) -> ArrayTable:
    return taps(a, square(1), lambda c: F.least(*c))


def median3(a: ArrayTable) -> ArrayTable:
    return taps(a, square(1), lambda c: F.array_sort(F.array(*c))[4])


#: Binomial weights of the 5-tap Gaussian.
BINOMIAL5 = (1, 4, 6, 4, 1)


def gaussian5(a: ArrayTable) -> ArrayTable:
    """5x5 binomial kernel, divided by 256 with rounding down."""
    kernel = {(x - 2, y - 2): BINOMIAL5[x] * BINOMIAL5[y] for x in range(5) for y in range(5)}
    return correlate(a, kernel, finish=lambda s: F.floor(s / 256))


def stencil5_u16(a: ArrayTable) -> ArrayTable:
    """Sum over 5x5 modulo 2^16."""
    return correlate(a, {o: 1 for o in square(2)}, finish=lambda s: F.pmod(s, F.lit(1 << 16)))


def harris(a: ArrayTable) -> ArrayTable:
    """Corner response with whole-number gradients: det - trace^2 div 25 of the summed
    gradient products."""

    def gradients(c: list[Column]) -> Column:
        at = dict(zip(square(1), c))
        gx = at[1, -1] + 2 * at[1, 0] + at[1, 1] - at[-1, -1] - 2 * at[-1, 0] - at[-1, 1]
        gy = at[-1, 1] + 2 * at[0, 1] + at[1, 1] - at[-1, -1] - 2 * at[0, -1] - at[1, -1]
        return gx * F.lit(1 << 20) + gy  # both in one number: |gy| stays below 2^19

    packed = taps(a, square(1), gradients).df
    gy = F.pmod(F.col("v") + (1 << 19), F.lit(1 << 20)) - (1 << 19)
    g = packed.select(*a.dims, gy.alias("gy"), F.shiftright(F.col("v") - gy, 20).alias("gx"))
    sent = F.explode(F.array(*[F.struct(*[(F.col(d) - o).cast("int").alias(d) for d, o in zip(a.dims, off)]) for off in square(1)])).alias("_t")
    s = g.select(sent, "gx", "gy").select("_t.*", "gx", "gy").groupBy(*a.dims)
    s = s.agg(F.sum(F.col("gx") * F.col("gx")).alias("xx"), F.sum(F.col("gy") * F.col("gy")).alias("yy"), F.sum(F.col("gx") * F.col("gy")).alias("xy"), F.count("*").alias("n")).where("n = 9")
    trace = F.col("xx") + F.col("yy")
    v = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - F.floor(trace * trace / 25)
    return ArrayTable(s.select(*a.dims, v.cast("bigint").alias("v")), a.dims, ("v",), (I64,), _shrunk(a, square(2)))


def max_disc(a: ArrayTable, radius: int) -> ArrayTable:
    """Greatest value within a disc."""
    disc = [(x, y) for x, y in square(radius) if x * x + y * y <= radius * radius + radius // 2]
    return taps(a, disc, lambda c: F.greatest(*c))


def life(a: ArrayTable, generations: int, persist: Callable | None = None) -> ArrayTable:
    """Conway's rule on a torus; ``persist`` (a function of a DataFrame) cuts the plan
    every few generations."""
    w, h = a.region[0].extent, a.region[1].extent
    df = a.df.select(*a.dims, F.col(a.values[0]).cast("bigint").alias("v"))
    x, y = a.dims
    for g in range(generations):
        near = F.explode(F.array(*[F.struct(F.pmod(F.col(x) + i, F.lit(w)).cast("int").alias(x), F.pmod(F.col(y) + j, F.lit(h)).cast("int").alias(y), F.lit(int((i, j) == (0, 0))).alias("own")) for i, j in square(1)])).alias("_t")
        s = df.select(near, "v").select("_t.*", "v").groupBy(x, y).agg(F.sum(F.when(F.col("own") == 0, F.col("v")).otherwise(0)).alias("n"), F.max(F.when(F.col("own") == 1, F.col("v"))).alias("c"))
        df = s.select(x, y, F.when((F.col("n") == 3) | ((F.col("n") == 2) & (F.col("c") == 1)), 1).otherwise(0).cast("bigint").alias("v"))
        if persist and g % 4 == 3:
            df = persist(df)
    return a._with(df, values=("v",), types=(I64,))


def nl_means(a: ArrayTable, patch: int, search: int, sigma: float) -> ArrayTable:
    """Non-local means: neighbours within ``search`` weighted by the distance of the
    patches around them.  Pairs (point, offset) come from one exploded join."""
    x, y = a.dims
    offs = [o for o in square(search)]
    src = a.df.select(x, y, F.col(a.values[0]).cast("double").alias("v"))
    moved = src.select(F.explode(F.array(*[F.struct((F.col(x) - i).cast("int").alias(x), (F.col(y) - j).cast("int").alias(y), F.lit(k).alias("k")) for k, (i, j) in enumerate(offs)])).alias("_t"), F.col("v").alias("u")).select("_t.*", "u")
    diff = src.join(moved, [x, y]).withColumn("d", (F.col("v") - F.col("u")) ** 2)
    spread = F.explode(F.array(*[F.struct((F.col(x) - i).cast("int").alias(x), (F.col(y) - j).cast("int").alias(y)) for i, j in square(patch)])).alias("_t")
    dist = diff.select(spread, "k", "d").select("_t.*", "k", "d").groupBy(x, y, "k").agg(F.sum("d").alias("d"))
    w = F.exp(-F.col("d") / (sigma * sigma * (2 * patch + 1) ** 2))
    # a patch's distance reaches places around the image too: only those inside have neighbours of their own
    inside = src.select(x, y).join(moved, [x, y])
    got = dist.join(inside, [x, y, "k"]).groupBy(x, y).agg((F.sum(w * F.col("u")) / F.sum(w)).alias("v"))
    return a._with(got, values=("v",), types=(a.types[0],))
