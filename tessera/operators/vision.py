"""Image programs put together from stencils, groupings and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import math

from ..functions.types import F64, I64
from .pixels import COMPOSITE, composite, linear_to_srgb, srgb_to_linear
from .reduce import affine_scan
from .stencil import BINOMIAL5, correlate, gaussian5, square, stencil5_u16, taps
from .table import ArrayTable


def unsharp(a: ArrayTable, amount: int = 1) -> ArrayTable:
    """clamp(v + amount * (v - gaussian), 0, 255)."""
    soft = gaussian5(a).df.select(*a.dims, F.col("v").alias("_g"))
    v = F.col(a.values[0])
    out = a.df.join(soft, list(a.dims)).select(*a.dims, F.greatest(F.least(v + amount * (v - F.col("_g")), F.lit(255)), F.lit(0)).alias("v"))
    return ArrayTable(out, a.dims, ("v",), (I64,))


def stereo_depth(left: ArrayTable, right: ArrayTable, max_shift: int, radius: int) -> ArrayTable:
    """The shift whose window differs least (first of equals): a cost volume of absolute
    differences, summed over windows, and its argmin."""
    x, y = left.dims
    moved = right.df.select(F.explode(F.array(*[F.struct((F.col(x) + s).cast("int").alias(x), F.lit(s).alias("s")) for s in range(max_shift)])).alias("_t"), y, F.col("v").alias("_r")).select("_t.*", y, "_r")
    cost = left.df.select(x, y, "v").join(moved, [x, y]).select(x, y, "s", F.abs(F.col("v") - F.col("_r")).alias("c"))
    near = square(radius)
    sent = F.explode(F.array(*[F.struct((F.col(x) - i).cast("int").alias(x), (F.col(y) - j).cast("int").alias(y)) for i, j in near])).alias("_t")
    sums = cost.select(sent, "s", "c").select("_t.*", "s", "c").groupBy(x, y, "s").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where(F.col("n") == len(near))
    best = sums.groupBy(x, y).agg(F.min(F.struct("c", "s")).alias("b"))
    return ArrayTable(best.select(x, y, F.col("b.s").cast("bigint").alias("v"), F.col("b.c").alias("cost")), (x, y), ("v", "cost"), (I64, I64))


def demosaic(raw: ArrayTable) -> ArrayTable:
    """Green at each point of a Bayer mosaic (green where x + y is even): itself, or the
    mean of its four neighbours rounded down."""
    x, y = raw.dims
    cross = correlate(raw, {(1, 0): 1, (-1, 0): 1, (0, 1): 1, (0, -1): 1}, finish=lambda s: F.floor(s / 4)).df.select(x, y, F.col("v").alias("_m"))
    out = raw.df.join(cross, [x, y])
    return ArrayTable(out.select(x, y, F.when(F.pmod(F.col(x) + F.col(y), F.lit(2)) == 0, F.col("v")).otherwise(F.col("_m")).cast("bigint").alias("v")), (x, y), ("v",), (I64,))


def color_matrix(rgb: dict[str, Column], matrix: list[list[int]], shift: int = 8) -> dict[str, Column]:
    """Whole-number 3x4 matrix (the last column is an offset), shifted and clamped to 0..255."""
    names = list(rgb)
    out = {}
    for name, row in zip(names, matrix):
        total = F.lit(row[3])
        for c, w in zip(names, row):
            total = total + rgb[c] * w
        out[name] = F.greatest(F.least(F.floor(total / (1 << shift)), F.lit(255)), F.lit(0)).cast("bigint")
    return out


def local_laplacian(a: ArrayTable, levels: int, bands: int, alpha: int, top: int = 256) -> ArrayTable:
    """Detail of each pyramid level comes from the band (a remapped image) that the
    level's own value points to; bands are rows with one more key, not separate plans."""
    x, y = a.dims
    step = top // bands
    k = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("k")
    remapped = a.df.select(x, y, k, "v").select(x, y, "k", (F.col("v") + F.floor((F.col("v") - F.col("k") * step) * alpha / 8)).cast("bigint").alias("v"))

    def half3(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys, F.floor(F.col(x) / 2).cast("int").alias(x), F.floor(F.col(y) / 2).cast("int").alias(y)).agg(F.floor(F.sum("v") / F.count("*")).cast("bigint").alias("v"))

    def detail(fine: DataFrame, coarse: DataFrame, keys: list[str]) -> DataFrame:
        low = coarse.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("v").alias("_low"))
        at = fine.withColumns({"_x": F.floor(F.col(x) / 2).cast("int"), "_y": F.floor(F.col(y) / 2).cast("int")})
        return at.join(low, [*keys, "_x", "_y"]).select(*keys, x, y, (F.col("v") - F.col("_low")).alias("v"))

    gauss, bandp = [a.df.select(x, y, "v")], [remapped]
    for _ in range(levels - 1):
        gauss.append(half3(gauss[-1], []))
        bandp.append(half3(bandp[-1], ["k"]))
    now = gauss[-1]
    for i in reversed(range(levels - 1)):
        d = detail(bandp[i], bandp[i + 1], ["k"]).select(x, y, "k", F.col("v").alias("_d"))
        pick = gauss[i].select(x, y, F.least(F.floor(F.col("v") / step), F.lit(bands - 1)).cast("int").alias("k")).join(d, [x, y, "k"]).select(x, y, "_d")
        up = now.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("v").alias("_up"))
        at = pick.withColumns({"_x": F.floor(F.col(x) / 2).cast("int"), "_y": F.floor(F.col(y) / 2).cast("int")})
        now = at.join(up, ["_x", "_y"]).select(x, y, (F.col("_d") + F.col("_up")).alias("v"))
    return ArrayTable(now, (x, y), ("v",), (I64,), a.region)


def grid_fit(low: DataFrame, cell: int) -> DataFrame:
    """(gx, gy, slope, offset): least-squares line from ``a`` to ``b`` in each coarse cell
    of (x, y, a, b); a flat cell has slope 0."""
    g = low.groupBy(F.floor(F.col("x") / cell).cast("int").alias("gx"), F.floor(F.col("y") / cell).cast("int").alias("gy"))
    s = g.agg(F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    den = F.col("n") * F.col("aa") - F.col("sa") * F.col("sa")
    slope = F.when(den == 0, F.lit(0.0)).otherwise((F.col("n") * F.col("ab") - F.col("sa") * F.col("sb")) / F.when(den == 0, F.lit(1)).otherwise(den))
    return s.withColumn("slope", slope).select("gx", "gy", "slope", ((F.col("sb") - F.col("slope") * F.col("sa")) / F.col("n")).alias("offset"))


def grid_apply(df: DataFrame, fit: DataFrame, cell: int) -> DataFrame:
    """The cell's line at each point of (x, y, a)."""
    at = df.withColumns({"gx": F.floor(F.col("x") / cell).cast("int"), "gy": F.floor(F.col("y") / cell).cast("int")})
    return at.join(fit, ["gx", "gy"]).select("x", "y", (F.col("slope") * F.col("a") + F.col("offset")).alias("v"))


def gaussian(a: ArrayTable, radius: int, sigma: float) -> ArrayTable:
    """Gaussian blur of any radius, one axis after the other, over points all of whose taps
    exist; weights add up to 1."""
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    weights = [w / sum(raw) for w in raw]
    for axis in range(2):
        a = correlate(a, {tuple(k if i == axis else 0 for i in range(2)): w for k, w in zip(range(-radius, radius + 1), weights)}, F64)
    return a


def unsharp_ratio(a: ArrayTable, radius: int, sigma: float) -> ArrayTable:
    """v times (2 g - blur) / g, with g = v + 1: a sharpened grey's ratio to itself."""
    grey = a._with(a.df.withColumn(a.values[0], F.col(a.values[0]).cast("double") + 1), types=(F64,))
    soft = gaussian(grey, radius, sigma).df.select(*a.dims, F.col("v").alias("_b"))
    g, v = F.col("_g"), F.col("_g") - 1
    out = grey.df.select(*a.dims, F.col(a.values[0]).alias("_g")).join(soft, list(a.dims)).select(*a.dims, (v * (2 * g - F.col("_b")) / g).alias("v"))
    return ArrayTable(out, a.dims, ("v",), (F64,))


def stencil_chain(a: ArrayTable, stages: int) -> ArrayTable:
    """5x5 sums modulo 2^16, one after another."""
    for _ in range(stages):
        a = stencil5_u16(a)
    return a


def linear_blur(a: ArrayTable, top: float = 255.0) -> ArrayTable:
    """3x3 mean in linear light: decoded, summed, encoded."""
    light = a._with(a.df.withColumn(a.values[0], srgb_to_linear(F.col(a.values[0]) / top)), types=(F64,))
    return correlate(light, {o: 1.0 for o in square(1)}, F64, lambda s: linear_to_srgb(s / 9))


def harris_float(a: ArrayTable, k: float = 0.04) -> ArrayTable:
    """det - k * trace^2 of the gradients' products (gradients in twelfths) over 3x3."""
    from . import halo

    x, y = a.dims
    near = square(1)
    read = halo.gather(a.df.select(x, y), [x, y], [(a.df.withColumn("_v", F.col(a.values[0]).cast("double")), "_v", [(o, f"_t{i}") for i, o in enumerate(near)])])
    at = {o: F.col(f"_t{i}") for i, o in enumerate(near)}
    gx = (at[1, -1] + 2 * at[1, 0] + at[1, 1] - at[-1, -1] - 2 * at[-1, 0] - at[-1, 1]) / 12
    gy = (at[-1, 1] + 2 * at[0, 1] + at[1, 1] - at[-1, -1] - 2 * at[0, -1] - at[1, -1]) / 12
    g = read.select(x, y, gx.alias("gx"), gy.alias("gy")).where("gx IS NOT NULL AND gy IS NOT NULL")
    g = g.select(x, y, (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy"))
    taps_of = lambda c: [(o, f"{c}{i}") for i, o in enumerate(near)]
    sums = halo.gather(g.select(x, y), [x, y], [(g, c, taps_of(c)) for c in ("xx", "yy", "xy")])
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, 9)), F.col(f"{c}0"))
    s = sums.select(x, y, *[total(c).alias(c) for c in ("xx", "yy", "xy")]).where("xx IS NOT NULL")
    trace = F.col("xx") + F.col("yy")
    return ArrayTable(s.select(x, y, (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - k * trace * trace).alias("v")), a.dims, ("v",), (F64,))


def composite_layers(layers: list[tuple[Column, Column]], rules: list[str]) -> tuple[Column, Column]:
    """Layers (value, alpha) from the bottom up, each laid on what is below by its rule."""
    if len(rules) != len(layers) - 1 or not set(rules) <= set(COMPOSITE):
        raise ValueError("a rule for each layer but the lowest")
    now = layers[0]
    for rule, top in zip(rules, layers[1:]):
        now = composite(rule, top, now)
    return now


def iir_blur(a: ArrayTable, alpha: float) -> ArrayTable:
    """First-order recursive blur down, up, right and left: each output is alpha of its input
    and the rest of the output before."""
    x, y = a.dims
    df = a.df.select(x, y, F.col(a.values[0]).cast("double").alias("v"))
    for key, order in ((x, y), (y, x)):
        for reverse in (False, True):
            df = affine_scan(df, [key], order, F.col("v") * alpha, F.lit(1 - alpha), block=256, reverse=reverse)
    return ArrayTable(df.select(x, y, "v"), a.dims, ("v",), (F64,), a.region)


def bilateral_trilinear(a: ArrayTable, s: int, r: int) -> ArrayTable:
    """Bilateral grid with a trilinear slice: counts and sums in cells of s x s points and r
    values (points go to the nearest), 1-4-6-4-1 blurs along all axes, and for each point
    the mean of its eight cells' sums by their counts, both weighted by nearness."""
    x, y = a.dims
    v = F.col(a.values[0])
    near = lambda c, n: F.floor((c + n / 2) / n).cast("int")
    g = a.df.select(near(F.col(x), s).alias("gx"), near(F.col(y), s).alias("gy"), near(v, r).alias("gz"), v.alias("_v")).groupBy("gx", "gy", "gz").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    for axis in ("gx", "gy", "gz"):
        others = [k for k in ("gx", "gy", "gz") if k != axis]
        to = F.inline(F.array(*[F.struct((F.col(axis) + k - 2).cast("int").alias(axis), F.lit(w).alias("w")) for k, w in enumerate(BINOMIAL5)]))
        g = g.select(*others, to, "n", "total").groupBy("gx", "gy", "gz").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("total") * F.col("w")).alias("total"))
    cell = lambda c, n: F.floor(c / n).cast("int")
    part = lambda c, n: (F.pmod(c, F.lit(n)) / n)
    places = [(F.col(x), s), (F.col(y), s), (v, r)]
    corners = []
    for k in range(8):
        w, fields = F.lit(1.0), []
        for i, (c, n) in enumerate(places):
            up = k >> i & 1
            w = w * (part(c, n) if up else 1 - part(c, n))
            fields.append((cell(c, n) + up).cast("int").alias(("gx", "gy", "gz")[i]))
        corners.append(F.struct(*fields, w.alias("w")))
    sent = a.df.select(x, y, F.inline(F.array(*corners))).where("w > 0")
    out = sent.join(g, ["gx", "gy", "gz"]).groupBy(x, y).agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))).alias("v"))
    return ArrayTable(out, a.dims, ("v",), (F64,), a.region)


def camera_pipe(raw: ArrayTable, matrix: list[list[int]], gamma: float = 1.8, top: int = 255) -> ArrayTable:
    """Raw mosaic (green, red / blue, green) to colors: hot points cut to the greatest of their
    four neighbours of the same color, missing colors as means of their neighbours, a
    whole-number color matrix, a curve, and sharpening by what a 3x3 mean takes away.  One
    exchange each for the neighbours at two, the colors and the sharpening."""
    x, y = raw.dims
    cross = [(0, 0), (2, 0), (-2, 0), (0, 2), (0, -2)]
    calm = taps(raw, cross, lambda c: F.least(c[0], F.greatest(*c[1:])))
    odd_x, odd_y = F.pmod(F.col(x), F.lit(2)) == 1, F.pmod(F.col(y), F.lit(2)) == 1

    def colors(c: list[Column]) -> Column:
        at = dict(zip(square(1), c))
        mean = lambda *o: F.floor(sum((at[k] for k in o[1:]), at[o[0]]) / len(o)).cast("bigint")
        own, sides, ends, corners, plus = at[0, 0], mean((-1, 0), (1, 0)), mean((0, -1), (0, 1)), mean((-1, -1), (1, -1), (-1, 1), (1, 1)), mean((-1, 0), (1, 0), (0, -1), (0, 1))
        green = F.when(odd_x == odd_y, own).otherwise(plus)
        red = F.when(odd_x & ~odd_y, own).when(~odd_x & ~odd_y, sides).when(odd_x & odd_y, ends).otherwise(corners)
        blue = F.when(~odd_x & odd_y, own).when(odd_x & odd_y, sides).when(~odd_x & ~odd_y, ends).otherwise(corners)
        return red * (1 << 40) + green * (1 << 20) + blue  # three in one number

    packed = taps(calm, square(1), colors).df
    part = lambda shift: F.shiftright("v", shift).bitwiseAND((1 << 20) - 1)
    rgb = color_matrix({"r": part(40), "g": part(20), "b": part(0)}, matrix)
    curve = lambda c: F.floor(top * F.pow(c / float(top), F.lit(1 / gamma)) + 0.5).cast("bigint")
    flat = packed.select(x, y, *[curve(c).alias(k) for k, c in rgb.items()])
    joined = flat.select(x, y, (F.col("r") * (1 << 40) + F.col("g") * (1 << 20) + F.col("b")).alias("v"))

    def sharpened(c: list[Column]) -> Column:
        out = F.lit(0).cast("bigint")
        for shift in (40, 20, 0):
            one = [F.shiftright(t, shift).bitwiseAND((1 << 20) - 1) for t in c]
            value = F.greatest(F.least(2 * one[4] - F.floor(sum(one[1:], one[0]) / 9), F.lit(top)), F.lit(0)).cast("bigint")
            out = out + value * (1 << shift)
        return out

    done = taps(ArrayTable(joined, (x, y), ("v",), (I64,)), square(1), sharpened).df
    return ArrayTable(done.select(x, y, part(40).alias("r"), part(20).alias("g"), part(0).alias("b")), (x, y), ("r", "g", "b"), (I64, I64, I64))
