"""Contractions: products of arrays summed over shared coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pixels import requantize


def matmul(a: DataFrame, b: DataFrame, block: int | None = None) -> DataFrame:
    """(i, j, v) from a (i, k, v) and b (k, j, v): join on k, sum by (i, j).

    With ``block`` the operands are cut into square blocks that meet by block indices:
    each cell travels once for each block row or column of the other operand instead of
    each product, and rows of a shared k do not pile up in one task."""
    if block is None:
        j = a.select("i", "k", F.col("v").alias("_a")).join(b.select("k", "j", F.col("v").alias("_b")), "k")
        return j.groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    at = lambda c: F.floor(F.col(c) / block).alias(f"_{c}b")
    left = a.groupBy(at("i"), at("k")).agg(F.collect_list(F.struct("i", "k", F.col("v").alias("a"))).alias("_x"))
    right = b.groupBy(at("k"), at("j")).agg(F.collect_list(F.struct("k", "j", F.col("v").alias("b"))).alias("_y"))
    pairs = left.join(right, "_kb").select("_ib", "_jb", F.explode("_x").alias("_l"), "_y")
    cells = pairs.select("_l", F.explode(F.filter("_y", lambda r: r["k"] == F.col("_l.k"))).alias("_r"))
    return cells.groupBy(F.col("_l.i").alias("i"), F.col("_r.j").alias("j")).agg(F.sum(F.col("_l.a") * F.col("_r.b")).alias("v"))


def transposed(a: DataFrame, c0: str, c1: str) -> DataFrame:
    return a.select(F.col(c1).alias(c0), F.col(c0).alias(c1), "v")


def gemm(a: DataFrame, b: DataFrame, c: DataFrame, alpha, beta, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """alpha * A B + beta * C."""
    p = matmul(transposed(a, "i", "k") if trans_a else a, transposed(b, "k", "j") if trans_b else b)
    out = c.select("i", "j", F.col("v").alias("_c")).join(p, ["i", "j"], "left")
    return out.select("i", "j", (F.coalesce("v", F.lit(0)) * alpha + F.col("_c") * beta).alias("v"))


def gemv(a: DataFrame, x: DataFrame, y: DataFrame, alpha, beta, trans: bool = False) -> DataFrame:
    a = transposed(a, "i", "k") if trans else a
    p = a.select("i", "k", F.col("v").alias("_a")).join(x.select(F.col("i").alias("k"), F.col("v").alias("_x")), "k").groupBy("i").agg(F.sum(F.col("_a") * F.col("_x")).alias("_p"))
    return y.join(p, "i", "left").select("i", (F.coalesce("_p", F.lit(0)) * alpha + F.col("v") * beta).alias("v"))


def ger(a: DataFrame, x: DataFrame, y: DataFrame, alpha) -> DataFrame:
    """A + alpha * x y', over A's cells (two lookups, no cross join)."""
    j = a.join(x.select("i", F.col("v").alias("_x")), "i").join(y.select(F.col("i").alias("j"), F.col("v").alias("_y")), "j")
    return j.select("i", "j", (F.col("v") + alpha * F.col("_x") * F.col("_y")).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("v").alias("_y")), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("_y")), F.lit(0)).alias("v"))


def asum(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.sum(F.abs("v")), F.lit(0)).alias("v"))


def axpy(x: DataFrame, y: DataFrame, alpha) -> DataFrame:
    return x.join(y.select("i", F.col("v").alias("_y")), "i").select("i", (alpha * F.col("v") + F.col("_y")).alias("v"))


def scal(x: DataFrame, alpha) -> DataFrame:
    return x.withColumn("v", F.col("v") * alpha)


#: Weights and biases of a layer are broadcast up to so many rows, else joined by channel.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def conv2d(data: DataFrame, weights: DataFrame, bias: DataFrame, relu: bool = True, stride: int = 1, groups: bool = False) -> DataFrame:
    """(n, y, x, co, v) from data (n, y, x, ci, v) and weights (co, ky, kx, ci, v):
    v = bias + sum of weight * data at (x * stride + kx, y * stride + ky); ``groups``:
    depthwise, co is ci.  Only outputs all of whose taps exist.

    Weights go to the data where they are few (counted first), so that no task gets all of
    a channel; products are summed on the way to their output."""
    w = weights.select("co", "ky", "kx", "ci", F.col("v").alias("_w"))
    j = data.join(_small(w), "ci")
    ox, oy = F.col("x") - F.col("kx"), F.col("y") - F.col("ky")
    j = j.where((F.pmod(ox, F.lit(stride)) == 0) & (F.pmod(oy, F.lit(stride)) == 0))
    need = weights.groupBy("co").agg(F.count("*").alias("_need"))
    s = j.groupBy("n", F.floor(oy / stride).cast("int").alias("y"), F.floor(ox / stride).cast("int").alias("x"), "co").agg(F.sum(F.col("v") * F.col("_w")).alias("_s"), F.count("*").alias("_n"))
    s = s.join(_small(need), "co").where("_n = _need").join(_small(bias.select(F.col("c").alias("co"), F.col("v").alias("_b"))), "co")
    v = F.col("_s") + F.col("_b")
    return s.select("n", "y", "x", "co", (F.greatest(v, F.lit(0)) if relu else v).alias("v"))


def quantized_conv2d(data: DataFrame, weights: DataFrame, bias: DataFrame, zero_in: int, zero_w: int, multiplier: int, shift: int, zero_out: int, lo: int = 0, hi: int = 255, stride: int = 1, groups: bool = False) -> DataFrame:
    """Convolution of 8-bit codes: (data - zero_in) * (weight - zero_w) summed exactly,
    plus bias, rescaled by multiplier / 2^shift with rounding, plus ``zero_out``, clamped."""
    shifted = [df.withColumn("v", F.col("v").cast("bigint") - z) for df, z in ((data, zero_in), (weights, zero_w))]
    acc = conv2d(*shifted, bias, relu=False, stride=stride, groups=groups)
    return acc.withColumn("v", requantize(F.col("v"), multiplier, shift, zero_out, lo, hi))


def _factor(n: int) -> int:
    """The greatest divisor of n up to its root."""
    return next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)


def _turn(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def fft(x: DataFrame, n: int, keys: list[str], inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of (keys..., i, re, im) along i, of n points that all
    exist.  With n = a * b the points with equal i mod b are transformed (a of them, each
    added to a sums), turned by their twiddle, and b sums of those are made; a and b that
    are not prime are cut again.  The inverse is divided by n."""
    sign = 1 if inverse else -1
    out = _fft(x.select(*keys, F.col("i").cast("int").alias("i"), "re", "im"), n, keys, sign, 0)
    return out.withColumns({"re": F.col("re") / n, "im": F.col("im") / n}) if inverse else out


def _fft(x: DataFrame, n: int, keys: list[str], sign: int, depth: int) -> DataFrame:
    a = _factor(n)
    if a == 1 or n <= 16:
        j = x.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        re, im = _turn(F.col("re"), F.col("im"), sign * 2 * F.pi() * F.pmod(F.col("i") * F.col("_f"), F.lit(n)) / n)
        return j.groupBy(*keys, F.col("_f").alias("i")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    b = n // a
    low = f"_r{depth}"
    inner = x.select(*keys, F.pmod("i", F.lit(b)).alias(low), F.floor(F.col("i") / b).cast("int").alias("i"), "re", "im")
    first = _fft(inner, a, [*keys, low], sign, depth + 1)  # keys, low, i: the first frequency
    re, im = _turn(F.col("re"), F.col("im"), sign * 2 * F.pi() * (F.col(low) * F.col("i")) / n)
    high = f"_h{depth}"
    turned = first.select(*keys, F.col("i").alias(high), F.col(low).alias("i"), re.alias("re"), im.alias("im"))
    second = _fft(turned, b, [*keys, high], sign, depth + 1)
    return second.select(*keys, (F.col(high) + a * F.col("i")).cast("int").alias("i"), "re", "im")


def fft2(x: DataFrame, w: int, h: int, inverse: bool = False) -> DataFrame:
    """(x, y, re, im) to (x, y, re, im): rows, then columns."""
    rows = fft(x.select("y", F.col("x").alias("i"), "re", "im"), w, ["y"], inverse)
    cols = fft(rows.select(F.col("i").alias("x"), F.col("y").alias("i"), "re", "im"), h, ["x"], inverse)
    return cols.select("x", F.col("i").alias("y"), "re", "im")


def fft2_real(a: DataFrame, w: int, h: int) -> DataFrame:
    """Spectrum of a real array (x, y, v): the columns 0 to w div 2, which hold it all."""
    rows = fft(a.select("y", F.col("x").alias("i"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")), w, ["y"])
    half = rows.where(F.col("i") <= w // 2)
    cols = fft(half.select(F.col("i").alias("x"), F.col("y").alias("i"), "re", "im"), h, ["x"])
    return cols.select("x", F.col("i").alias("y"), "re", "im")


def fft2_to_real(s: DataFrame, w: int, h: int) -> DataFrame:
    """The real array (x, y, v) of a half spectrum: the other half is its conjugate, seen
    from the opposite corner."""
    cols = fft(s.select("x", F.col("y").alias("i"), "re", "im"), h, ["x"], inverse=True).select("x", F.col("i").alias("y"), "re", "im")
    # after the columns each row is the spectrum of a real row
    other = cols.where((F.col("x") > 0) & (F.col("x") * 2 < w)).select((F.lit(w) - F.col("x")).cast("int").alias("x"), "y", "re", (-F.col("im")).alias("im"))
    rows = fft(cols.unionByName(other).select("y", F.col("x").alias("i"), "re", "im"), w, ["y"], inverse=True)
    return rows.select(F.col("i").alias("x"), "y", F.col("re").alias("v"))
