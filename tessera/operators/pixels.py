"""Pointwise operators: compositing, transfer curves, fixed-point network layers, and
tensor operators by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the compositing rules, by the share that each layer keeps:
#: (of the upper layer, of the lower layer), given both alphas in 0..255.
COMPOSITE: dict[str, tuple[Callable, Callable]] = {
    "over": (lambda a, b: F.lit(255), lambda a, b: 255 - a),
    "atop": (lambda a, b: b, lambda a, b: 255 - a),
    "xor": (lambda a, b: 255 - b, lambda a, b: 255 - a),
    "in": (lambda a, b: b, lambda a, b: F.lit(0)),
    "out": (lambda a, b: 255 - b, lambda a, b: F.lit(0)),
}


def div255(x: Column) -> Column:
    """x / 255 rounded to nearest, for 0 <= x <= 65025."""
    return F.floor((x + 127) / 255)


def composite(rule: str, top: tuple[Column, Column], low: tuple[Column, Column]) -> tuple[Column, Column]:
    """(value, alpha) of one layer on another; values are premultiplied by alpha."""
    ft, fl = COMPOSITE[rule]
    (tv, ta), (lv, la) = top, low
    mix = lambda t, u: div255(t * ft(ta, la)) + div255(u * fl(ta, la))
    return F.least(mix(tv, lv), F.lit(255)), F.least(mix(ta, la), F.lit(255))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def requantize(acc: Column, multiplier: int, shift: int, zero: int, lo: int = 0, hi: int = 255) -> Column:
    """Fixed-point rescale of an accumulator: (acc * m + half) >> shift, plus the zero
    point, clamped."""
    scaled = F.shiftright(acc.cast("bigint") * multiplier + (1 << shift - 1 if shift else 0), shift)
    return F.greatest(F.least(scaled + zero, F.lit(hi)), F.lit(lo)).cast("bigint")


def quantized_add(a: Column, b: Column, za: int, zb: int, ma: int, mb: int, shift: int, zero: int) -> Column:
    return requantize((a.cast("bigint") - za) * ma + (b.cast("bigint") - zb) * mb, 1, shift, zero)


def quantized_mul(a: Column, b: Column, za: int, zb: int, m: int, shift: int, zero: int) -> Column:
    return requantize((a.cast("bigint") - za) * (b.cast("bigint") - zb), m, shift, zero)


def pool(df: DataFrame, kind: str, size: int, stride: int, keys: list[str]) -> DataFrame:
    """Max or average pooling of (keys, x, y, v): see ``pools``."""
    return pools(df, {"v": kind}, size, stride, keys)


def pools(df: DataFrame, kinds: dict[str, str], size: int, stride: int, keys: list[str]) -> DataFrame:
    """Poolings ("max", "min", "avg" or "sum") by result name, in one pass: cells of a
    window meet by its index; averages round half up; windows cut by the edge use what
    they have."""
    lo = lambda c: F.greatest(F.ceil((F.col(c) - size + 1) / stride), F.lit(0)).cast("int")
    hi = lambda c: F.floor(F.col(c) / stride).cast("int")
    d = df.select(*keys, "y", F.explode(F.sequence(lo("x"), hi("x"))).alias("px"), "v") if size > stride else df.where(lo("x") <= hi("x")).select(*keys, "y", hi("x").alias("px"), "v")
    d = d.select(*keys, "px", F.explode(F.sequence(lo("y"), hi("y"))).alias("py"), "v") if size > stride else d.where(lo("y") <= hi("y")).select(*keys, "px", hi("y").alias("py"), "v")
    by = {"max": F.max("v"), "min": F.min("v"), "sum": F.sum("v"), "avg": F.floor((F.sum("v") + F.floor(F.count("*") / 2)) / F.count("*")).cast("bigint")}
    return d.groupBy(*keys, F.col("px").alias("x"), F.col("py").alias("y")).agg(*[by[k].alias(name) for name, k in kinds.items()])


def softmax(df: DataFrame, keys: list[str], v: str = "v", log: bool = False, beta: float = 1.0) -> DataFrame:
    """Along all coordinates but ``keys``, with the maximum taken out first."""
    w = Window.partitionBy(*keys)
    e = df.withColumn("_m", (F.col(v) - F.max(v).over(w)) * beta)
    s = F.sum(F.exp("_m")).over(w)
    return e.withColumn(v, F.col("_m") - F.log(s) if log else F.exp("_m") / s).drop("_m")


def l2_normalize(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    n = F.sqrt(F.sum(F.col(v) * F.col(v)).over(Window.partitionBy(*keys)))
    return df.withColumn(v, F.when(n > 0, F.col(v) / n).otherwise(0.0))


def batch_norm(df: DataFrame, stats: DataFrame, key: str, eps: float = 1e-5) -> DataFrame:
    """stats: key, scale, bias, mean, var."""
    j = df.join(stats, key)
    return j.withColumn("v", (F.col("v") - F.col("mean")) / F.sqrt(F.col("var") + eps) * F.col("scale") + F.col("bias")).drop("scale", "bias", "mean", "var")


def lrn(df: DataFrame, keys: list[str], channel: str, size: int, alpha: float, beta: float, bias: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(channel).rangeBetween(-((size - 1) // 2), size // 2)
    return df.withColumn("v", F.col("v") / F.pow(bias + alpha / size * F.sum(F.col("v") * F.col("v")).over(w), F.lit(beta)))


_S = F.lit


def _erf(x: Column) -> Column:
    from ..functions.expr import _erf as series

    return series(x)


#: Unary tensor operators.
UNARY: dict[str, Callable[[Column], Column]] = {
    "Abs": F.abs, "Acos": F.acos, "Acosh": F.acosh, "Asin": F.asin, "Asinh": F.asinh, "Atan": F.atan, "Atanh": F.atanh,
    "Ceil": F.ceil, "Cos": F.cos, "Cosh": F.cosh, "Cast": lambda x: x.cast("int"), "Erf": _erf, "Exp": F.exp, "Floor": F.floor, "Identity": lambda x: x, "IsNaN": F.isnan,
    "IsInf": lambda x: F.abs(x) == float("inf"), "Log": F.log, "Neg": lambda x: -x, "Not": lambda x: ~x, "Reciprocal": lambda x: 1 / x,
    "Relu": lambda x: F.greatest(x, _S(0.0)), "Sigmoid": lambda x: 1 / (1 + F.exp(-x)), "Sign": F.signum, "Sin": F.sin, "Sinh": F.sinh,
    "Softplus": lambda x: F.log1p(F.exp(x)), "Softsign": lambda x: x / (1 + F.abs(x)), "Sqrt": F.sqrt, "Tan": F.tan, "Tanh": F.tanh,
    "Square": lambda x: x * x, "Relu6": lambda x: F.least(F.greatest(x, _S(0.0)), _S(6.0)), "ReluN1To1": lambda x: F.least(F.greatest(x, _S(-1.0)), _S(1.0)),
}

#: Operators of one tensor with parameters.
ACTIVATIONS: dict[str, Callable] = {
    "Elu": lambda x, alpha=1.0: F.when(x < 0, alpha * (F.exp(x) - 1)).otherwise(x),
    "Selu": lambda x, alpha=1.6732632, gamma=1.0507010: gamma * F.when(x <= 0, alpha * (F.exp(x) - 1)).otherwise(x),
    "LeakyRelu": lambda x, alpha=0.01: F.when(x < 0, alpha * x).otherwise(x),
    "ThresholdedRelu": lambda x, alpha=1.0: F.when(x > alpha, x).otherwise(_S(0.0)),
    "Shrink": lambda x, lambd=0.5, bias=0.0: F.when(x < -lambd, x + bias).when(x > lambd, x - bias).otherwise(_S(0.0)),
    "Clip": lambda x, min=float("-inf"), max=float("inf"): F.greatest(F.least(x, _S(max)), _S(min)),
    "Scale": lambda x, scale=1.0: x * scale,
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "Add": lambda a, b: a + b, "And": lambda a, b: a & b, "Div": lambda a, b: a / b, "Equal": lambda a, b: a == b, "Greater": lambda a, b: a > b,
    "Less": lambda a, b: a < b, "LessEqual": lambda a, b: a <= b, "NotEqual": lambda a, b: a != b, "Max": F.greatest, "Min": F.least, "Mean": lambda a, b: (a + b) / 2, "Mul": lambda a, b: a * b,
    "Or": lambda a, b: a | b, "Pow": F.pow, "PRelu": lambda a, b: F.when(a < 0, a * b).otherwise(a), "Sub": lambda a, b: a - b,
    "Xor": lambda a, b: a != b, "Sum": lambda a, b: a + b,
}

REDUCE: dict[str, Callable[[Column], Column]] = {
    "ReduceSum": F.sum, "ReduceSumSquare": lambda v: F.sum(v * v), "ReduceLogSum": lambda v: F.log(F.sum(v)),
    "ReduceLogSumExp": lambda v: F.log(F.sum(F.exp(v))), "ReduceProd": F.product, "ReduceMean": F.avg, "ReduceMin": F.min, "ReduceMax": F.max,
    "ReduceL1": lambda v: F.sum(F.abs(v)), "ReduceL2": lambda v: F.sqrt(F.sum(v * v)),
}


def unary(df: DataFrame, op: str, v: str = "v", **params) -> DataFrame:
    return df.withColumn(v, UNARY[op](F.col(v)) if op in UNARY else ACTIVATIONS[op](F.col(v), **params))


def binary(a: DataFrame, b: DataFrame, op: str, on: list[str]) -> DataFrame:
    """Identity or broadcasting join: ``on`` are the coordinates that b has."""
    return a.join(b.select(*on, F.col("v").alias("_b")), on).withColumn("v", BINARY[op](F.col("v"), F.col("_b"))).drop("_b")


def reduce_axes(df: DataFrame, op: str, keep: list[str]) -> DataFrame:
    return df.groupBy(*keep).agg(REDUCE[op](F.col("v")).alias("v"))


def variadic(tables: list[DataFrame], op: str, on: list[str]) -> DataFrame:
    """Sum, Mean, Max or Min of several tensors, point by point."""
    names = [f"_v{i}" for i in range(len(tables))]
    j = tables[0].select(*on, F.col("v").alias(names[0]))
    for n, t in zip(names[1:], tables[1:]):
        j = j.join(t.select(*on, F.col("v").alias(n)), on)
    cols = [F.col(n) for n in names]
    total = reduce(lambda a, b: a + b, cols)
    v = {"Sum": total, "Mean": total / len(cols), "Max": F.greatest(*cols), "Min": F.least(*cols)}[op]
    return j.select(*on, v.alias("v"))


def global_pool(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """One value for each of ``keys`` (image and channel)."""
    return df.groupBy(*keys).agg({"avg": F.avg("v"), "max": F.max("v"), "min": F.min("v")}[kind].alias("v"))


def dropout(df: DataFrame) -> DataFrame:
    """At inference nothing is dropped."""
    return df


def where(cond: DataFrame, a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    j = cond.select(*on, F.col("v").alias("_c")).join(a.select(*on, F.col("v").alias("_a")), on).join(b.select(*on, F.col("v").alias("_b")), on)
    return j.select(*on, F.when(F.col("_c"), F.col("_a")).otherwise(F.col("_b")).alias("v"))


def gather(data: DataFrame, index: DataFrame, axis: str) -> DataFrame:
    """Rows of ``data`` by ``index`` (i, v): axis takes the place i of the index."""
    return data.withColumnRenamed(axis, "_g").join(index.select("i", F.col("v").alias("_g")), "_g").withColumnRenamed("i", axis).drop("_g")


def one_hot(index: DataFrame, depth: int, on: float = 1.0, off: float = 0.0) -> DataFrame:
    return index.select("i", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("k"), F.col("v").alias("_v")).select("i", "k", F.when(F.col("k") == F.col("_v"), on).otherwise(off).alias("v"))


def reshape(df: DataFrame, dims: list[tuple[str, int]], new: list[tuple[str, int]]) -> DataFrame:
    """Row-major: the last dimension runs fastest."""
    flat = F.lit(0).cast("bigint")
    for name, extent in dims:
        flat = flat * extent + F.col(name)
    df, step, cols = df.withColumn("_flat", flat), 1, []
    for name, extent in reversed(new):
        cols.append(F.pmod(F.call_function("div", F.col("_flat"), F.lit(step).cast("bigint")), F.lit(extent)).cast("int").alias(name))
        step *= extent
    return df.select(*reversed(cols), "v")


def split(df: DataFrame, axis: str, sizes: list[int]) -> list[DataFrame]:
    """Parts along an axis, each from 0 on."""
    out, at = [], 0
    for n in sizes:
        out.append(df.where(F.col(axis).between(at, at + n - 1)).withColumn(axis, (F.col(axis) - at).cast("int")))
        at += n
    return out


def concat(parts: list[DataFrame], axis: str, sizes: list[int]) -> DataFrame:
    moved, at = [], 0
    for p, n in zip(parts, sizes):
        moved.append(p.withColumn(axis, (F.col(axis) + at).cast("int")))
        at += n
    return reduce(DataFrame.unionByName, moved)


def pad(df: DataFrame, dims: list[tuple[str, int]], before: list[int], after: list[int], value=0.0) -> DataFrame:
    """A constant around a tensor of the given extents."""
    from ..plans.region import box
    from .table import domain

    names = [d for d, _ in dims]
    every = domain(df.sparkSession, names, box(*[n + a + b for (_, n), a, b in zip(dims, before, after)]))
    moved = df.select(*[(F.col(d) + a).cast("int").alias(d) for d, a in zip(names, before)], "v")
    return every.join(moved, names, "left").select(*names, F.coalesce("v", F.lit(value)).alias("v"))


def expand(df: DataFrame, axis: str, times: int) -> DataFrame:
    """An axis of extent 1 (or a new one) repeated."""
    return df.drop(axis).withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def unsqueeze(df: DataFrame, axis: str) -> DataFrame:
    return df.withColumn(axis, F.lit(0))


def squeeze(df: DataFrame, axis: str) -> DataFrame:
    return df.drop(axis)


def flatten(df: DataFrame, dims: list[tuple[str, int]], at: int) -> DataFrame:
    """Two axes: those before ``at`` in one, the others in the other."""
    size = lambda part: reduce(lambda a, d: a * d[1], part, 1)
    return reshape(df, dims, [("i", size(dims[:at])), ("j", size(dims[at:]))])


def shape_of(df: DataFrame, dims: list[str]) -> DataFrame:
    """axis, v: the extents, as data (a tensor starts at 0)."""
    tops = df.agg(*[(F.max(d) + 1).alias(d) for d in dims])
    return tops.select(F.posexplode(F.array(*[F.col(d).cast("bigint") for d in dims])).alias("axis", "v"))


def size_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("v"))


def constant_of_shape(spark, dims: list[tuple[str, int]], value=0.0) -> DataFrame:
    from ..plans.region import box
    from .table import domain

    return domain(spark, [d for d, _ in dims], box(*[n for _, n in dims])).withColumn("v", F.lit(value))


def random_tensor(spark, dims: list[tuple[str, int]], kind: str, seed: int = 0, low: float = 0.0, high: float = 1.0, mean: float = 0.0, scale: float = 1.0) -> DataFrame:
    """"uniform" in [low, high) or "normal": functions of the coordinates and the seed, so
    a lost task makes the same numbers again."""
    from ..functions import expr as E
    from ..functions.types import I32

    at = [E.col(d, I32) for d, _ in dims]
    u = E.random_float(at, seed).column().cast("double")
    if kind == "uniform":
        v = low + u * (high - low)
    else:  # two uniforms make a normal
        w = E.random_float(at, seed, 1).column().cast("double")
        v = mean + scale * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * w)
    return constant_of_shape(spark, dims).withColumn("v", v)


def quantized_softmax(df: DataFrame, keys: list[str], scale: float, beta: float = 1.0) -> DataFrame:
    """Codes of scale ``scale`` to codes of 1/256: probabilities, rounded and clamped."""
    p = softmax(df.withColumn("v", F.col("v") * scale), keys, beta=beta)
    return p.withColumn("v", F.least(F.floor(F.col("v") * 256 + 0.5), F.lit(255)).cast("bigint"))


def quantized_l2(df: DataFrame, keys: list[str], zero: int) -> DataFrame:
    """Codes to codes of 1/128 around 128: unit vectors."""
    u = l2_normalize(df.withColumn("v", (F.col("v") - zero).cast("double")), keys)
    return u.withColumn("v", F.greatest(F.least(F.floor(F.col("v") * 128 + 128.5), F.lit(255)), F.lit(0)).cast("bigint"))


def quantized_unary(op: str, v: Column, scale: float, zero: int, scale_out: float, zero_out: int) -> Column:
    """A unary operator on the numbers that 8-bit codes stand for."""
    real = (v - zero) * scale
    out = {"Logistic": lambda x: 1 / (1 + F.exp(-x))}.get(op, UNARY.get({"Negate": "Neg"}.get(op, op)))(real)
    return F.greatest(F.least(F.floor(out / scale_out + 0.5) + zero_out, F.lit(255)), F.lit(0)).cast("bigint")


def quantized_compare(op: str, a: Column, b: Column, sa: float, za: int, sb: float, zb: int) -> Column:
    """Comparisons of the numbers that codes of two scales stand for."""
    return BINARY[op]((a - za) * sa, (b - zb) * sb)


def elementwise_program(inputs: list[Column], program: list[tuple]) -> Column:
    """A straight-line program of 16-bit registers: register 0 is zero, then come the inputs
    and each step's result; the last is the value.  Steps are (op, a, b, c): a is a
    register, b a register or, with "_imm" after the name, a number, c a shift."""

    def sat(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit((1 << 15) - 1)), F.lit(-(1 << 15))).cast("bigint")

    regs = [F.lit(0).cast("bigint"), *[c.cast("bigint") for c in inputs]]
    for op, a, b, c in program:
        kind, x, y = op.removesuffix("_imm"), regs[a], F.lit(b).cast("bigint") if op.endswith("_imm") else regs[b]
        half = 1 << c - 1 if c else 0
        regs.append({
            "add": lambda: sat(x + y), "sub": lambda: sat(x - y), "min": lambda: F.least(x, y), "max": lambda: F.greatest(x, y),
            "mul_shift": lambda: sat(F.shiftright(x * y + half, c)), "clamp": lambda: F.greatest(F.least(x, F.lit(c)), y),
        }[kind]())
    return regs[-1]


def upsample_channels(df: DataFrame, factor: int) -> DataFrame:
    """Channel c to channels c * factor and on, all alike."""
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("c", (F.col("c") * factor + F.col("_k")).cast("int")).drop("_k")


def tile_filter(weights: DataFrame, group_out: int, group_in: int) -> DataFrame:
    """Weights (co, ky, kx, ci, v) with output and input channels cut into groups: the
    layout (ob, ib, ky, kx, o, i)."""
    cut = lambda c, n: (F.floor(F.col(c) / n).cast("int"), F.pmod(c, F.lit(n)).cast("int"))
    (ob, o), (ib, i) = cut("co", group_out), cut("ci", group_in)
    return weights.select(ob.alias("ob"), ib.alias("ib"), "ky", "kx", o.alias("o"), i.alias("i"), "v")


def tile(df: DataFrame, axis: str, extent: int, times: int) -> DataFrame:
    return df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, (F.col(axis) + F.col("_t") * extent).cast("int")).drop("_t")


def space_to_depth(df: DataFrame, block: int, channels: int) -> DataFrame:
    """(x, y, c) to (x div b, y div b, c + channels * (place in the block))."""
    place = F.pmod("y", F.lit(block)) * block + F.pmod("x", F.lit(block))
    return df.select(F.floor(F.col("x") / block).cast("int").alias("x"), F.floor(F.col("y") / block).cast("int").alias("y"), (F.col("c") + place * channels).cast("int").alias("c"), "v")


def depth_to_space(df: DataFrame, block: int, channels: int) -> DataFrame:
    place = F.floor(F.col("c") / channels)
    return df.select((F.col("x") * block + F.pmod(place, F.lit(block))).cast("int").alias("x"), (F.col("y") * block + F.floor(place / block)).cast("int").alias("y"), F.pmod("c", F.lit(channels)).cast("int").alias("c"), "v")
