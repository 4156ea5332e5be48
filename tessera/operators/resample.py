"""Resampling: pyramids, resizing, wavelets, and grids in value space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import F64, I64
from ..plans.region import Range
from .reduce import histogram
from .table import ArrayTable


def half(c: str) -> Column:
    return F.floor(F.col(c) / 2).cast("int")


def downsample(a: ArrayTable) -> ArrayTable:
    """Mean of 2x2 cells, rounded down: one grouping by halved coordinates."""
    x, y = a.dims
    got = a.df.groupBy(half(x).alias(x), half(y).alias(y)).agg(F.floor(F.sum(a.values[0]) / F.count("*")).cast("bigint").alias("v"))
    r = None if a.region is None else tuple(Range(q.min // 2, (q.extent + 1) // 2) for q in a.region)
    return ArrayTable(got, a.dims, ("v",), (I64,), r)


def upsample(a: ArrayTable) -> ArrayTable:
    """Each cell four times: no join, since a cell knows who reads it."""
    x, y = a.dims
    to = F.explode(F.array(*[F.struct((F.col(x) * 2 + i).cast("int").alias(x), (F.col(y) * 2 + j).cast("int").alias(y)) for i in (0, 1) for j in (0, 1)])).alias("_t")
    got = a.df.select(to, *a.values).select("_t.*", *a.values)
    r = None if a.region is None else tuple(Range(q.min * 2, q.extent * 2) for q in a.region)
    return a._with(got, region=r)


def laplacian_level(a: ArrayTable) -> ArrayTable:
    """a minus its down- and upsampled self."""
    low = upsample(downsample(a)).df.select(*a.dims, F.col("v").alias("_low"))
    return ArrayTable(a.df.join(low, list(a.dims)).select(*a.dims, (F.col(a.values[0]) - F.col("_low")).alias("v")), a.dims, ("v",), (I64,), a.region)


def pyramid(a: ArrayTable, levels: int) -> list[ArrayTable]:
    out = [a]
    for _ in range(levels - 1):
        out.append(downsample(out[-1]))
    return out


def pull_push(a: ArrayTable, levels: int) -> ArrayTable:
    """Fills points of weight 0 (values v and weight w) from coarser means."""
    x, y = a.dims
    stack = [a.df.select(x, y, (F.col("v") * F.col("w")).alias("v"), F.col("w"))]
    for _ in range(levels - 1):
        stack.append(stack[-1].groupBy(half(x).alias(x), half(y).alias(y)).agg((F.sum("v") / 4).alias("v"), (F.sum("w") / 4).alias("w")))
    now = stack[-1]
    for level in reversed(stack[:-1]):
        coarse = now.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("v").alias("_v"), F.col("w").alias("_w"))
        j = level.join(coarse, (half(x) == F.col("_x")) & (half(y) == F.col("_y")))
        now = j.select(x, y, (F.col("v") + (1 - F.col("w")) * F.col("_v")).alias("v"), (F.col("w") + (1 - F.col("w")) * F.col("_w")).alias("w"))
    return a._with(now.select(x, y, F.when(F.col("w") > 0, F.col("v") / F.col("w")).otherwise(0.0).alias("v")), values=("v",), types=(F64,))


#: Radius and weight of each kernel, as a function of the distance in kernel units.
KERNELS = {
    "box": (0.5, lambda t: F.when(F.abs(t) <= 0.5, 1.0).otherwise(0.0)),
    "linear": (1.0, lambda t: F.greatest(1 - F.abs(t), F.lit(0.0))),
    "cubic": (2.0, lambda t: F.when(F.abs(t) < 1, 1.5 * F.abs(t) ** 3 - 2.5 * t * t + 1).when(F.abs(t) < 2, -0.5 * F.abs(t) ** 3 + 2.5 * t * t - 4 * F.abs(t) + 2).otherwise(0.0)),
    "lanczos": (3.0, lambda t: F.when(t == 0, 1.0).when(F.abs(t) < 3, F.sin(t * math.pi) * F.sin(t * math.pi / 3) / ((t * math.pi) * (t * math.pi / 3))).otherwise(0.0)),
}


def resize_1d(a: ArrayTable, d, scale: float, extent: int, kernel: str = "linear") -> ArrayTable:
    """Along one dimension: each source point is sent to the outputs whose kernel covers
    it, and weights are normalised by their sum."""
    radius, weight = KERNELS[kernel]
    c = a.dims[a._at(d)]
    k = min(scale, 1.0)  # shrinking widens the kernel
    reach = radius / k
    lo = F.greatest(F.ceil((F.col(c) - reach + 0.5) * scale - 0.5).cast("int"), F.lit(0))
    hi = F.least(F.floor((F.col(c) + reach + 0.5) * scale - 0.5).cast("int"), F.lit(extent - 1))
    others = [x for x in a.dims if x != c]
    sent = a.df.where(lo <= hi).select(*others, F.col(c).alias("_s"), F.col(a.values[0]).cast("double").alias("_v"), F.explode(F.sequence(lo, hi)).alias(c))
    t = (F.col("_s") - ((F.col(c) + 0.5) / scale - 0.5)) * k
    got = sent.withColumn("_w", weight(t)).groupBy(*others, c).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("v"))
    r = None if a.region is None else tuple(Range(0, extent) if x == c else q for x, q in zip(a.dims, a.region))
    return ArrayTable(got, a.dims, ("v",), (F64,), r)


def haar(a: ArrayTable, d=0) -> ArrayTable:
    """(x, c): sums (c = 0) and differences (c = 1) of neighbours, as s + e and s - e."""
    c = a.dims[a._at(d)]
    rest = [x for x in a.dims if x != c]
    v, odd = F.col(a.values[0]), F.pmod(F.col(c), F.lit(2)) == 1
    g = a.df.groupBy(*rest, half(c).alias(c)).agg(F.sum(v).alias("s"), F.sum(F.when(odd, -v).otherwise(v)).alias("e"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("s").alias("v")), F.struct(F.lit(1).alias("c"), F.col("e").alias("v")))).alias("_t")
    got = g.select(*rest, c, both).select(*a.dims, "_t.*")
    r = None if a.region is None else (*[Range(q.min // 2, (q.extent + 1) // 2) if x == c else q for x, q in zip(a.dims, a.region)], Range(0, 2))
    return ArrayTable(got, (*a.dims, "c"), ("v",), a.types, r)


def inverse_haar(a: ArrayTable, d=0) -> ArrayTable:
    c = a.dims[a._at(d)]
    rest = [x for x in a.dims if x not in (c, "c")]
    g = a.df.groupBy(*rest, c).agg(F.sum(F.when(F.col("c") == 0, F.col("v"))).alias("s"), F.sum(F.when(F.col("c") == 1, F.col("v"))).alias("e"))
    both = F.explode(F.array(F.struct((F.col(c) * 2).cast("int").alias("_x"), F.floor((F.col("s") + F.col("e")) / 2).alias("v")), F.struct((F.col(c) * 2 + 1).cast("int").alias("_x"), F.floor((F.col("s") - F.col("e")) / 2).alias("v")))).alias("_t")
    got = g.select(*rest, both).select(*rest, F.col("_t._x").alias(c), F.col("_t.v").cast("bigint").alias("v"))
    return ArrayTable(got, tuple(x for x in a.dims if x != "c"), ("v",), a.types)


def _d4() -> tuple[float, ...]:
    r, n = math.sqrt(3), 4 * math.sqrt(2)
    return ((1 + r) / n, (3 + r) / n, (3 - r) / n, (1 - r) / n)


def daubechies(a: ArrayTable, d=0) -> ArrayTable:
    """Four-tap wavelet at 2x .. 2x + 3; outputs all of whose taps exist."""
    c = a.dims[a._at(d)]
    h = _d4()
    rest = [x for x in a.dims if x != c]
    low, high = h, (h[3], -h[2], h[1], -h[0])
    taps = F.explode(F.array(*[F.struct((F.col(c) - k).alias("_p"), F.lit(low[k]).alias("l"), F.lit(high[k]).alias("h")) for k in range(4)])).alias("_t")
    s = a.df.select(*rest, taps, F.col(a.values[0]).alias("_v")).select(*rest, "_t.*", "_v").where(F.pmod("_p", F.lit(2)) == 0)
    g = s.groupBy(*rest, (F.col("_p") / 2).cast("int").alias(c)).agg(F.sum(F.col("_v") * F.col("l")).alias("l"), F.sum(F.col("_v") * F.col("h")).alias("h"), F.count("*").alias("n")).where("n = 4")
    both = F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("l").alias("v")), F.struct(F.lit(1).alias("c"), F.col("h").alias("v")))).alias("_t")
    return ArrayTable(g.select(*rest, c, both).select(*a.dims, "_t.*"), (*a.dims, "c"), ("v",), (F64,))


def inverse_daubechies(a: ArrayTable, d=0) -> ArrayTable:
    """Points to which two wavelet outputs contribute."""
    c = a.dims[a._at(d)]
    h = _d4()
    low, high = h, (h[3], -h[2], h[1], -h[0])
    rest = [x for x in a.dims if x not in (c, "c")]
    to = F.explode(F.array(*[F.struct((F.col(c) * 2 + k).cast("int").alias("_x"), F.when(F.col("c") == 0, low[k]).otherwise(high[k]).alias("w")) for k in range(4)])).alias("_t")
    g = a.df.select(*rest, to, "v").select(*rest, "_t.*", "v").groupBy(*rest, F.col("_x").alias(c)).agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.count("*").alias("n")).where("n = 4")
    return ArrayTable(g.drop("n"), tuple(x for x in a.dims if x != "c"), ("v",), (F64,))


def bilateral_grid(a: ArrayTable, s: int, bins: int, top: int = 256) -> DataFrame:
    """Splat: (gx, gy, gz, n, total) over coarse cells and value bins; a 4-D histogram."""
    x, y = a.dims
    z = F.floor(F.col(a.values[0]) * bins / top)
    keys = {"gx": half_n(x, s), "gy": half_n(y, s), "gz": z.cast("int")}
    return a.df.select(*[c.alias(k) for k, c in keys.items()], F.col(a.values[0]).alias("_v")).groupBy("gx", "gy", "gz").agg(F.count("*").alias("n"), F.sum("_v").cast("bigint").alias("total"))


def half_n(c: str, s: int) -> Column:
    return F.floor(F.col(c) / s).cast("int")


def bilateral_filter(a: ArrayTable, s: int, bins: int, top: int = 256) -> ArrayTable:
    """Grid, 1-4-6-4-1 blur over the three grid axes, and lookup of each point's cell:
    floor(total / n)."""
    from .stencil import BINOMIAL5

    g = bilateral_grid(a, s, bins, top)
    for axis in ("gx", "gy", "gz"):
        others = [k for k in ("gx", "gy", "gz") if k != axis]
        to = F.explode(F.array(*[F.struct((F.col(axis) + k - 2).cast("int").alias(axis), F.lit(w).alias("w")) for k, w in enumerate(BINOMIAL5)])).alias("_t")
        g = g.select(*others, to, "n", "total").select(*others, "_t.*", "n", "total").groupBy("gx", "gy", "gz").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("total") * F.col("w")).alias("total"))
    x, y = a.dims
    z = F.floor(F.col(a.values[0]) * bins / top).cast("int")
    keyed = a.df.select(x, y, half_n(x, s).alias("gx"), half_n(y, s).alias("gy"), z.alias("gz"))
    return ArrayTable(keyed.join(g, ["gx", "gy", "gz"]).select(x, y, F.floor(F.col("total") / F.col("n")).cast("bigint").alias("v")), a.dims, ("v",), (I64,), a.region)


def equalize(a: ArrayTable, levels: int = 256) -> ArrayTable:
    """Histogram equalization: counts, running sum over the levels, and lookup.  Only the
    table of levels is ordered and broadcast."""
    from pyspark.sql import Window

    v = a.values[0]
    h = histogram(a.df, {"bin": (F.col(v), levels)})
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = h.select("bin", F.sum("n").over(w).alias("c"), F.sum("n").over(Window.partitionBy()).alias("t"))
    lut = cdf.select("bin", F.least(F.lit(levels - 1), F.call_function("div", F.col("c") * (levels - 1), F.greatest("t", F.lit(1)))).cast("bigint").alias("v"))
    keyed = a.df.select(*a.dims, F.greatest(F.least(F.col(v), F.lit(levels - 1)), F.lit(0)).cast("int").alias("bin"))
    return ArrayTable(keyed.join(F.broadcast(lut), "bin").select(*a.dims, "v"), a.dims, ("v",), (I64,), a.region)  # `levels` rows


