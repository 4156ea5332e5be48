"""Tensor operators by name, quantized layers, sorting networks, array files, resizing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.types import F64, I64, U8, U16
from ..operators import contract, networks, pixels, resample
from ..operators.table import ArrayTable, domain, generate, make_scalar
from ..plans.autodiff import gradients
from ..plans.region import Range, box
from ..sources import codecs, grids
from .arrays import EMB, HEIGHT, IMG

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _rounded(df: DataFrame, keys: list[str], cols: dict, digits: int) -> DataFrame:
    return df.select(*keys, *[F.round(c.cast("double"), digits).alias(k) for k, c in cols.items()])


_ERF = "(sign(v) * (1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-v * v)))".format(t="(1 / (1 + 0.3275911 * abs(v)))")
#: Operator: what it is applied to (an SQL expression of v, and of columns) and its SQL.
_UNARY = {
    "Abs": ("v", "abs(v)"), "Acos": ("v / (1 + abs(v))", "acos(v / (1 + abs(v)))"), "Acosh": ("1 + abs(v)", "acosh(1 + abs(v))"), "Asin": ("v / (1 + abs(v))", "asin(v / (1 + abs(v)))"),
    "Asinh": ("v", "asinh(v)"), "Atan": ("v", "atan(v)"), "Atanh": ("v / (1 + abs(v))", "atanh(v / (1 + abs(v)))"), "Cast": ("v * 10", "trunc(v * 10)"), "Ceil": ("v * 10", "ceil(v * 10)"), "Cos": ("v", "cos(v)"), "Cosh": ("v", "cosh(v)"),
    "Erf": ("v", _ERF), "Exp": ("v", "exp(v)"), "Floor": ("v * 10", "floor(v * 10)"), "Identity": ("v", "v"), "Log": ("1 + abs(v)", "ln(1 + abs(v))"), "Neg": ("v", "-v"), "Reciprocal": ("2 + abs(v)", "1 / (2 + abs(v))"),
    "Relu": ("v", "greatest(v, 0)"), "Sigmoid": ("v", "1 / (1 + exp(-v))"), "Sign": ("v", "sign(v)"), "Sin": ("v", "sin(v)"), "Sinh": ("v", "sinh(v)"), "Softplus": ("v", "ln(1 + exp(v))"), "Softsign": ("v", "v / (1 + abs(v))"),
    "Sqrt": ("abs(v)", "sqrt(abs(v))"), "Tan": ("v", "tan(v)"), "Tanh": ("v", "tanh(v)"), "Square": ("v", "v * v"), "Relu6": ("v * 10", "least(greatest(v * 10, 0), 6)"), "ReluN1To1": ("v * 10", "least(greatest(v * 10, -1), 1)"),
}


@query("tensor_unary", f"WITH {EMB} SELECT i, d, {', '.join(f'round(CAST({sql} AS DOUBLE), 7) + 0 AS {op.lower()}_' for op, (_, sql) in _UNARY.items())}, isnan(v) AS nan_, isinf(v) AS inf_, NOT v > 0 AS not_ FROM emb")
def tensor_unary(spark, d):
    df = grids.embedding(spark, d).df
    cols = [(F.round(pixels.UNARY[op](F.expr(on)).cast("double"), 7) + 0.0).alias(op.lower() + "_") for op, (on, _) in _UNARY.items()]
    v = F.col("v")
    return df.select("i", "d", *cols, pixels.UNARY["IsNaN"](v).alias("nan_"), pixels.UNARY["IsInf"](v).alias("inf_"), pixels.UNARY["Not"](v > 0).alias("not_"))


_BINARY = {
    "Add": "v + m", "Div": "v / (m + 9)", "Max": "greatest(v, m)", "Mean": "(v + m) / 2", "Min": "least(v, m)", "Mul": "v * m", "PRelu": "CASE WHEN v < 0 THEN v * m ELSE v END", "Sub": "v - m", "Sum": "v + m",
    "Equal": "v = m", "Greater": "v > m", "Less": "v < m", "LessEqual": "v <= m", "NotEqual": "v <> m",
}


@query("tensor_binary_ops", f"WITH {EMB}, w AS (SELECT d, max(v) AS m FROM emb GROUP BY d) SELECT i, emb.d, {', '.join((f'round({s}, 6)' if k[0] != 'E' and k not in ('Greater', 'Less', 'LessEqual', 'NotEqual') else s) + f' AS {k.lower()}_' for k, s in _BINARY.items())}, round(pow(abs(v) + 1, m), 6) AS pow_, v > 0 AND m > 1 AS and_, v > 0 OR m > 1 AS or_, (v > 0) <> (m > 1) AS xor_ FROM emb JOIN w ON w.d = emb.d")
def tensor_binary_ops(spark, d):
    e = grids.embedding(spark, d).df
    j = e.join(pixels.reduce_axes(e, "ReduceMax", ["d"]).withColumnRenamed("v", "m"), "d")
    v, m, b = F.col("v"), F.col("m"), pixels.BINARY
    cols = []
    for k, s in _BINARY.items():
        c = b[k](v, m + 9 if k == "Div" else m)
        cols.append((c if s[1:4] in (" = ", " > ", " < ") or "<" in s and "CASE" not in s else F.round(c, 6)).alias(k.lower() + "_"))
    logic = {"and_": "And", "or_": "Or", "xor_": "Xor"}
    return j.select("i", "d", *cols, F.round(b["Pow"](F.abs(v) + 1, m), 6).alias("pow_"), *[b[op](v > 0, m > 1).alias(k) for k, op in logic.items()])


@query("tensor_variadic", f"WITH {EMB} SELECT i, d, round(v + v * v + 1, 6) AS s, round((v + v * v + 1) / 3, 6) AS m, round(greatest(v, v * v, 1), 6) AS hi, round(least(v, v * v, 1), 6) AS lo FROM emb")
def tensor_variadic(spark, d):
    e = grids.embedding(spark, d).df.select("i", "d", "v")
    tables, on = [e, pixels.unary(e, "Square"), e.withColumn("v", F.lit(1.0))], ["i", "d"]
    out = None
    for name, op in (("s", "Sum"), ("m", "Mean"), ("hi", "Max"), ("lo", "Min")):
        one = pixels.variadic(tables, op, on).withColumnRenamed("v", name)
        out = one if out is None else out.join(one, on)
    return out.select(*on, *[F.round(c, 6).alias(c) for c in ("s", "m", "hi", "lo")])


@query("tensor_reduce_ops", f"WITH {EMB} SELECT i, round(sum(v * v), 6) AS sq, round(ln(sum(abs(v))), 6) AS ls, round(product(1 + v / 100), 7) AS pr, min(v) AS lo, max(v) AS hi FROM emb GROUP BY i")
def tensor_reduce_ops(spark, d):
    v, r = F.col("v"), pixels.REDUCE
    return grids.embedding(spark, d).df.groupBy("i").agg(
        F.round(r["ReduceSumSquare"](v), 6).alias("sq"), F.round(r["ReduceLogSum"](F.abs(v)), 6).alias("ls"), F.round(r["ReduceProd"](1 + v / 100), 7).alias("pr"), r["ReduceMin"](v).alias("lo"), r["ReduceMax"](v).alias("hi")
    )


@query("tensor_norms", f"WITH {EMB}, m AS (SELECT i, max(v) AS m, avg(v) AS a FROM emb GROUP BY i), s AS (SELECT emb.i, ln(sum(exp(v - m.m))) AS s FROM emb JOIN m USING (i) GROUP BY 1) SELECT i, d, round(v - m.m - s.s, 7) AS lsm, round(m.a, 7) AS gap, m.m AS gmp, v AS dropped FROM emb JOIN m USING (i) JOIN s USING (i)")
def tensor_norms(spark, d):
    e = grids.embedding(spark, d).df.select("i", "d", "v")
    out = pixels.softmax(e.withColumn("dropped", F.col("v")), ["i"], log=True)
    for kind, name in (("avg", "gap"), ("max", "gmp")):
        out = out.join(pixels.global_pool(pixels.dropout(e), kind, ["i"]).withColumnRenamed("v", name), "i")
    return out.select("i", "d", F.round("v", 7).alias("lsm"), F.round("gap", 7).alias("gap"), "gmp", "dropped")


@query("activations_more", f"WITH {EMB} SELECT i, d, round(1.0507010 * CASE WHEN v <= 0 THEN 1.6732632 * (exp(v) - 1) ELSE v END, 7) AS selu, round(CASE WHEN v > 0.3 THEN v ELSE 0 END, 7) AS thr, round(CASE WHEN v < -0.2 THEN v + 0.1 WHEN v > 0.2 THEN v - 0.1 ELSE 0 END, 7) AS shr, round(v * 2.5, 7) AS sc FROM emb")
def activations_more(spark, d):
    v, a = F.col("v"), pixels.ACTIVATIONS
    cols = {"selu": a["Selu"](v), "thr": a["ThresholdedRelu"](v, alpha=0.3), "shr": a["Shrink"](v, lambd=0.2, bias=0.1), "sc": a["Scale"](v, scale=2.5)}
    return _rounded(grids.embedding(spark, d).df, ["i", "d"], cols, 7)


@query("tensor_shape_ops", f"""WITH {EMB}, t AS (SELECT CAST(i AS INT) AS i, CAST(d AS INT) AS d, v FROM emb)
SELECT 'split' AS op, i, d - 40 AS d, 0 AS k, v FROM t WHERE d >= 40 UNION ALL SELECT 'joined', i, d, 0, v FROM t
UNION ALL SELECT 'padded', i, CAST(p.range AS INT), 0, CASE WHEN p.range BETWEEN 2 AND 65 THEN v ELSE -1 END FROM range(69) p JOIN t ON t.d = greatest(least(p.range - 2, 63), 0)
UNION ALL SELECT 'expanded', i, d, CAST(k.range AS INT), v FROM t CROSS JOIN range(3) k UNION ALL SELECT 'tiled', i, d + 64 * CAST(k.range AS INT), 0, v FROM t CROSS JOIN range(2) k
UNION ALL SELECT 'flat', 0, i * 64 + d, 0, v FROM t UNION ALL SELECT 'squeezed', i, d, 0, v FROM t""")
def tensor_shape_ops(spark, d):
    e = grids.embedding(spark, d).df.select(F.col("i").cast("int").alias("i"), F.col("d").cast("int").alias("d"), "v")
    n = e.agg(F.max("i")).first()[0] + 1
    parts = pixels.split(e, "d", [40, 24])
    made = {
        "split": parts[1], "joined": pixels.concat(parts, "d", [40, 24]), "padded": pixels.pad(e, [("i", n), ("d", 64)], [0, 2], [0, 3], -1.0), "expanded": pixels.expand(pixels.unsqueeze(e, "k"), "k", 3),
        "tiled": pixels.tile(e, "d", 64, 2), "flat": pixels.flatten(e, [("i", n), ("d", 64)], 0).select("i", F.col("j").alias("d"), "v"), "squeezed": pixels.squeeze(pixels.unsqueeze(e, "k"), "k"),
    }
    rows = [df.select(F.lit(op).alias("op"), "i", "d", F.col("k") if "k" in df.columns else F.lit(0).alias("k"), "v") for op, df in made.items()]
    return reduce(DataFrame.union, rows)


@query("tensor_shape_size", f"WITH {EMB} SELECT 0 AS axis, CAST(max(i) + 1 AS BIGINT) AS v FROM emb UNION ALL SELECT 1, CAST(max(d) + 1 AS BIGINT) FROM emb UNION ALL SELECT -1, count(*) FROM emb")
def tensor_shape_size(spark, d):
    e = grids.embedding(spark, d).df
    return pixels.shape_of(e, ["i", "d"]).union(pixels.size_of(e).select(F.lit(-1).alias("axis"), "v"))


@query("tensor_where", f"WITH {EMB} SELECT i, d, CASE WHEN v > 0 THEN v ELSE 0.5 END AS v FROM emb")
def tensor_where(spark, d):
    e = grids.embedding(spark, d).df.select("i", "d", "v")
    return pixels.where(e.withColumn("v", F.col("v") > 0), e, e.withColumn("v", F.lit(0.5)), ["i", "d"])


@query("tensor_sources", "SELECT i.range::INT AS i, j.range::INT AS j, 2.5::DOUBLE AS c, true AS inside, true AS mean_ok, true AS spread_ok FROM range(64) i, range(64) j")
def tensor_sources(spark, d):
    """A constant, and random fields whose range and moments are checked."""
    dims = [("i", 64), ("j", 64)]
    u = pixels.random_tensor(spark, dims, "uniform", 3, -2.0, 5.0)
    g = pixels.random_tensor(spark, dims, "normal", 4, mean=1.0, scale=2.0)
    one = u.agg(F.bool_and(F.col("v").between(-2.0, 5.0)).alias("inside")).join(F.broadcast(g.agg((F.abs(F.avg("v") - 1) < 0.15).alias("mean_ok"), (F.abs(F.stddev("v") - 2) < 0.15).alias("spread_ok"))))
    return pixels.constant_of_shape(spark, dims, 2.5).withColumnRenamed("v", "c").join(F.broadcast(one))  # one row


@query("grid_sources", "SELECT 'zero' AS kind, x.range::INT AS x, y.range::INT AS y, 0e0 AS v FROM range(40) x, range(30) y UNION ALL SELECT 'constant', x.range::INT, y.range::INT, 7.25e0 FROM range(40) x, range(30) y UNION ALL SELECT 'identity', x.range::INT, y.range::INT, CASE WHEN x.range = y.range THEN 1e0 ELSE 0e0 END FROM range(40) x, range(30) y UNION ALL SELECT 'random', x.range::INT, y.range::INT, 1e0 FROM range(40) x, range(30) y UNION ALL SELECT 'scalar', 0, 0, 3e0 UNION ALL SELECT 'each', x.range::INT, y.range::INT, (x.range * y.range)::DOUBLE FROM range(40) x, range(30) y")
def grid_sources(spark, d):
    rows = []
    for kind, spec in (("zero", "zero:"), ("constant", "constant:7.25"), ("identity", "identity:"), ("random", "random:5")):
        a = grids.synthetic(spark, spec, ("x", "y"), [40, 30]).df
        rows.append(a.select(F.lit(kind).alias("kind"), "x", "y", (F.col("v").between(0, 0.9999999).cast("double") if kind == "random" else F.col("v").cast("double")).alias("v")))
    rows.append(make_scalar(spark, 3).df.select(F.lit("scalar"), F.lit(0), F.lit(0), F.col("v").cast("double")))
    rows.append(generate(spark, ("x", "y"), [40, 30], F.col("x") * F.col("y")).df.select(F.lit("each"), "x", "y", F.col("v").cast("double")))
    return reduce(DataFrame.union, rows)


@query("table_layout", f"""WITH {IMG} SELECT 'set_min' AS op, x + 5 AS a, y - 7 AS b, 0 AS c, v FROM img UNION ALL SELECT 'reverse_axes', y, x, 0, v FROM img UNION ALL SELECT 'add_dimension', x, y, 0, v FROM img
UNION ALL SELECT 'interleaved', x % 4, x // 4, y, v FROM img UNION ALL SELECT 'planar', x // 4, y, x % 4, v FROM img UNION ALL SELECT 'shape_of', x, y, 0, 9 FROM img UNION ALL SELECT 'at_many', x, y, 0, v FROM img WHERE x % 10 = 0""")
def table_layout(spark, d):
    a = grids.image(spark, d, region=True)
    cut = a._with(a.df.select(F.floor(F.col("x") / 4).cast("int").alias("x"), F.pmod("x", F.lit(4)).alias("ch"), "y", "v"), dims=("x", "ch", "y"), region=(Range(0, 25), Range(0, 4), a.region[1]))
    made = {
        "set_min": a.set_min(5, -7), "reverse_axes": a.reverse_axes(), "add_dimension": a.add_dimension("c"), "interleaved": cut.interleaved("ch"), "planar": cut.planar("ch"), "shape_of": a.with_shape_of(a, 9),
    }
    rows = [t.df.select(F.lit(op).alias("op"), *[F.col(n).alias(k) for n, k in zip(t.dims, "abc")], *([] if len(t.dims) > 2 else [F.lit(0).alias("c")]), "v") for op, t in made.items()]
    some = a.df.where("x % 10 = 0").select("x", "y")
    rows.append(a.at_many(some).select(F.lit("at_many").alias("op"), F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("c"), "v"))
    return reduce(DataFrame.union, rows)


@query("table_facts", f"""WITH {IMG}, {HEIGHT} SELECT 0 AS place, 'x' AS dim, -3 AS min, 100 AS extent, 1::BIGINT AS stride, true AS checks FROM h UNION ALL SELECT 1, 'y', 0, h, 100, true FROM h""")
def table_facts(spark, d):
    """Regions, sizes and element access of a table."""
    a = grids.image(spark, d, region=True).translate("x", -3).as_type(I64, 2)
    h = a.height
    checks = [a.width == 100, a.left == -3, a.right == 96, a.top == 0, a.bottom == h - 1, a.number_of_elements() == 100 * h, a.size_in_bytes() == 800 * h, a.contains(-3, 0), not a.contains(97, 0), a.at(-3, 0) is not None, a.at(97, 0) is None, a.dim("x").extent == 100, a.check_dense(), a.fill(4).all_equal(4)]
    return a.describe().withColumn("checks", F.lit(all(checks)))


@query("quantized_conv", f"""WITH {IMG}, dt AS (SELECT y, x // 4 AS x, x % 4 AS ci, v FROM img), w AS (SELECT co.range AS co, ky.range AS ky, kx.range AS kx, ci.range AS ci, (co.range * 31 + ky.range * 17 + kx.range * 5 + ci.range * 7) % 256 AS w FROM range(3) co, range(3) ky, range(3) kx, range(4) ci),
s AS (SELECT dt.y - w.ky AS y, dt.x - w.kx AS x, co, sum((v - 128) * (w - 120)) + 100 * co AS s, count(*) AS n FROM dt JOIN w USING (ci) GROUP BY 1, 2, 3 HAVING count(*) = 36)
SELECT 0 AS n, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(co AS INT) AS co, CAST(greatest(least(CAST(floor((s * 23 + 32768) / 65536.0) AS BIGINT) + 100, 255), 0) AS BIGINT) AS v FROM s""")
def quantized_conv(spark, d):
    data = grids.image(spark, d).df.select(F.lit(0).alias("n"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), F.pmod("x", F.lit(4)).alias("ci"), "v")
    w = domain(spark, ["co", "ky", "kx", "ci"], box(3, 3, 3, 4)).withColumn("v", (F.col("co") * 31 + F.col("ky") * 17 + F.col("kx") * 5 + F.col("ci") * 7) % 256)
    bias = spark.range(3).select(F.col("id").cast("int").alias("c"), (F.col("id") * 100).alias("v"))
    return contract.quantized_conv2d(data, w, bias, 128, 120, 23, 16, 100)


@query("quantized_depthwise", f"""WITH {IMG}, dt AS (SELECT y, x // 4 AS x, x % 4 AS ci, v FROM img), w AS (SELECT ci.range AS ci, ky.range AS ky, kx.range AS kx, (ky.range * 17 + kx.range * 5 + ci.range * 7) % 256 AS w FROM range(3) ky, range(3) kx, range(4) ci),
s AS (SELECT dt.y - w.ky AS y, dt.x - w.kx AS x, ci, sum((v - 128) * (w - 20)) AS s FROM dt JOIN w USING (ci) GROUP BY 1, 2, 3 HAVING count(*) = 9),
q AS (SELECT y, x, ci, CAST(greatest(least(CAST(floor((s * 23 + 4096) / 8192.0) AS BIGINT) + 100, 255), 0) AS BIGINT) AS v FROM s)
SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(ci * 2 + k.range AS INT) AS c, v FROM q CROSS JOIN range(2) k""")
def quantized_depthwise(spark, d):
    """Depthwise, then each channel twice."""
    data = grids.image(spark, d).df.select(F.lit(0).alias("n"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), F.pmod("x", F.lit(4)).alias("ci"), "v")
    w = domain(spark, ["ci", "ky", "kx"], box(4, 3, 3)).withColumn("co", F.col("ci")).withColumn("v", (F.col("ky") * 17 + F.col("kx") * 5 + F.col("ci") * 7) % 256)
    bias = spark.range(4).select(F.col("id").cast("int").alias("c"), F.lit(0).cast("bigint").alias("v"))
    out = contract.quantized_conv2d(data, w, bias, 128, 20, 23, 13, 100, groups=True)
    return pixels.upsample_channels(out.select("y", "x", F.col("co").alias("c"), "v"), 2)


@query("separable_conv", f"""WITH {IMG}, dt AS (SELECT y, x // 4 AS x, x % 4 AS ci, v FROM img), w AS (SELECT ci.range AS ci, ky.range AS ky, kx.range AS kx, (2 * ci.range + 2 * ky.range - kx.range) % 5 - 2 AS w FROM range(4) ci, range(3) ky, range(3) kx),
s AS (SELECT dt.y - w.ky AS y, dt.x - w.kx AS x, ci, sum(v * w) AS s FROM dt JOIN w USING (ci) GROUP BY 1, 2, 3 HAVING count(*) = 9)
SELECT 0 AS n, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(co.range AS INT) AS co, CAST(greatest(0, sum(s * (co.range - ci + 1)) + 5 * co.range) AS BIGINT) AS v FROM s CROSS JOIN range(3) co GROUP BY y, x, co.range""")
def separable_conv(spark, d):
    """Depthwise, then pointwise with bias and a floor at zero."""
    data = grids.image(spark, d).df.select(F.lit(0).alias("n"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), F.pmod("x", F.lit(4)).alias("ci"), "v")
    w = domain(spark, ["ci", "ky", "kx"], box(4, 3, 3)).withColumn("co", F.col("ci")).withColumn("v", (2 * F.col("ci") + 2 * F.col("ky") - F.col("kx")) % 5 - 2)
    none = spark.range(4).select(F.col("id").cast("int").alias("c"), F.lit(0).cast("bigint").alias("v"))
    deep = contract.conv2d(data, w, none, relu=False, groups=True).withColumnRenamed("co", "ci")
    point = domain(spark, ["co", "ky", "kx", "ci"], box(3, 1, 1, 4)).withColumn("v", F.col("co") - F.col("ci") + 1)
    bias = spark.range(3).select(F.col("id").cast("int").alias("c"), (F.col("id") * 5).alias("v"))
    return contract.conv2d(deep, point, bias)


@query("tiled_filter", "SELECT co.range::INT // 4 AS ob, ci.range::INT // 2 AS ib, ky.range::INT AS ky, kx.range::INT AS kx, co.range::INT % 4 AS o, ci.range::INT % 2 AS i, (co.range * 9 + ky.range * 3 + kx.range + ci.range)::INT AS v FROM range(8) co, range(3) ky, range(3) kx, range(4) ci")
def tiled_filter(spark, d):
    w = domain(spark, ["co", "ky", "kx", "ci"], box(8, 3, 3, 4)).withColumn("v", F.col("co") * 9 + F.col("ky") * 3 + F.col("kx") + F.col("ci"))
    return pixels.tile_filter(w, 4, 2)


@query("quantized_layers", f"""WITH {IMG}, m AS (SELECT y, max(v) AS m FROM img GROUP BY y), s AS (SELECT y, sum(exp((v - m) / 16.0)) AS s, sqrt(sum((v - 100) * (v - 100))::DOUBLE) AS l FROM img JOIN m USING (y) GROUP BY y)
SELECT x, y, CAST(least(floor(exp((v - m) / 16.0) / s * 256 + 0.5), 255) AS BIGINT) AS sm, CAST(greatest(least(floor((v - 100) / l * 128 + 128.5), 255), 0) AS BIGINT) AS l2,
CAST(greatest(least(floor(1 / (1 + exp(-(v - 128) / 32.0)) * 256 + 0.5), 255), 0) AS BIGINT) AS lg, CAST(greatest(least(floor(tanh((v - 128) / 32.0) * 128 + 0.5) + 128, 255), 0) AS BIGINT) AS th, CAST(greatest(least(256 - v, 255), 0) AS BIGINT) AS ng,
(v - 10) * 0.5 < (v * 3 % 256 - 20) * 0.25 AS lt, (v - 10) * 0.5 = (v * 3 % 256 - 20) * 0.25 AS eq,
CAST(greatest(least(floor(((v - 12) * 90 - (v * 3 % 256 - 20) * 70 + 64) / 128.0) + 5, 255), 0) AS BIGINT) AS sb FROM img JOIN m USING (y) JOIN s USING (y)""")
def quantized_layers(spark, d):
    df = grids.image(spark, d).df
    soft = pixels.quantized_softmax(df, ["y"], 1 / 16).withColumnRenamed("v", "sm")
    unit = pixels.quantized_l2(df, ["y"], 100).withColumnRenamed("v", "l2")
    v, w = F.col("v"), F.pmod(F.col("v") * 3, F.lit(256))
    one = df.select(
        "x", "y", pixels.quantized_unary("Logistic", v, 1 / 32, 128, 1 / 256, 0).alias("lg"), pixels.quantized_unary("Tanh", v, 1 / 32, 128, 1 / 128, 128).alias("th"), pixels.quantized_unary("Negate", v, 1 / 32, 128, 1 / 32, 128).alias("ng"),
        pixels.quantized_compare("Less", v, w, 0.5, 10, 0.25, 20).alias("lt"), pixels.quantized_compare("Equal", v, w, 0.5, 10, 0.25, 20).alias("eq"), pixels.quantized_add(v, w, 12, 20, 90, -70, 7, 5).alias("sb"),
    )
    return one.join(soft, ["x", "y"]).join(unit, ["x", "y"])


@query("elementwise_program", f"WITH {IMG}, r AS (SELECT x, y, v AS a, (v * 5) % 256 AS b FROM img), s AS (SELECT x, y, a - b AS t, CAST(floor(((a - b) * 77 + 64) / 128.0) AS BIGINT) AS u, b FROM r) SELECT x, y, CAST(greatest(least(greatest(u, b - 100), 200), -200) AS BIGINT) AS v FROM s")
def elementwise_program(spark, d):
    v = F.col("v")
    program = [("sub", 1, 2, 0), ("mul_shift_imm", 3, 77, 7), ("sub_imm", 2, 100, 0), ("max", 4, 5, 0), ("clamp_imm", 6, -200, 200)]
    return grids.image(spark, d).df.select("x", "y", pixels.elementwise_program([v, F.pmod(v * 5, F.lit(256))], program).alias("v"))


@query("bitonic_sort", f"WITH {EMB} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS INT) AS d, v FROM emb")
def bitonic_sort(spark, d):
    e = grids.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return e.select("i", F.posexplode(networks.bitonic_sort(F.col("a"), 64)).alias("d", "v"))


@query("merge_sort", f"WITH {EMB} SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS INT) AS d, v FROM emb")
def merge_sort(spark, d):
    e = grids.read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return e.select("i", F.posexplode(networks.merge_sort(F.col("a"), 64)).alias("d", "v"))


_FORMATS = ("npy", "png", "pgm", "tmp", "mat", "tif")


@query("file_round_trips", f"WITH {IMG} SELECT f AS format, x, y, CAST(v AS DOUBLE) AS v FROM img CROSS JOIN (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in _FORMATS)}) t(f)")
def file_round_trips(spark, d):
    """The image in bands of rows, written by the tasks as files of every format, and read."""
    a = grids.image(spark, d, region=True)
    rows = [codecs.load_bands(codecs.write_bands(a._with(a.df, types=(U8,)), f, 64), f).select(F.lit(f).alias("format"), "x", "y", "v") for f in _FORMATS]
    return reduce(DataFrame.union, rows)


@query("convert_types", f"WITH {IMG} SELECT x, y, v * 257 AS u16, v / 255e0 AS f64, v AS back, CAST(v // 2 AS BIGINT) AS s8 FROM img")
def convert_types(spark, d):
    a = grids.image(spark, d)
    a = a._with(a.df.withColumn("v", F.col("v").cast("smallint")), types=(U8,))
    from ..functions.types import I8

    wide = codecs.convert_image(a, U16)
    out = wide.df.select("x", "y", F.col("v").cast("bigint").alias("u16"))
    for name, t in (("f64", codecs.convert_image(a, F64)), ("back", codecs.convert_image(codecs.convert_image(a, F64), U8)), ("s8", codecs.convert_image(a, I8))):
        out = out.join(t.df.select("x", "y", F.col("v").cast("double" if name == "f64" else "bigint").alias(name)), ["x", "y"])
    return out


def _kernel_sql(kind: str) -> str:
    return {
        "box": "CASE WHEN abs(t) <= 0.5 THEN 1.0 ELSE 0.0 END",
        "cubic": "CASE WHEN abs(t) < 1 THEN 1.5 * abs(t) * abs(t) * abs(t) - 2.5 * t * t + 1 WHEN abs(t) < 2 THEN -0.5 * abs(t) * abs(t) * abs(t) + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0.0 END",
        "lanczos": "CASE WHEN t = 0 THEN 1.0 WHEN abs(t) < 3 THEN sin(t * pi()) * sin(t * pi() / 3) / ((t * pi()) * (t * pi() / 3)) ELSE 0.0 END",
    }[kind]


for _kind in ("box", "cubic", "lanczos"):

    def _resized(spark, d, kind=_kind):
        out = resample.resize_1d(grids.image(spark, d), "x", 0.4, 40, kind).df
        return out.select("y", "x", F.round("v", 6).alias("v"))

    QUERIES[f"resize_{_kind}"] = (_resized, f"WITH {IMG}, t AS (SELECT y, o.range AS x, CAST((s.x - ((o.range + 0.5) / 0.4::DOUBLE - 0.5)) * 0.4::DOUBLE AS DOUBLE) AS t, v FROM img s CROSS JOIN range(40) o), w AS (SELECT *, {_kernel_sql(_kind)} AS w FROM t) SELECT y, CAST(x AS INT) AS x, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY y, x HAVING sum(abs(w)) > 0")


_A, _B = E.col("a", F64), E.col("b", F64)
#: An expression and its derivative by a, in SQL, for a = p_size / 60 (0 to 1), b = p_retailprice / 1000 + 1.
_GRAD = {
    "powc": (E.pow_(_A + 1.0, E.const(1.5, F64)), "1.5 * sqrt(a + 1)"), "powv": (E.pow_(_B, _A), "pow(b, a) * ln(b)"), "at2": (E.atan2(_A, _B), "b / (a * a + b * b)"), "erf": (E.erf(_A), "1.1283791670955126 * exp(-a * a)"),
    "tan": (E.tan(_A), "1 / (cos(a) * cos(a))"), "asin": (E.asin(_A / 2.0), "0.5 / sqrt(1 - a * a / 4)"), "acos": (E.acos(_A / 2.0), "-0.5 / sqrt(1 - a * a / 4)"), "asinh": (E.asinh(_A), "1 / sqrt(a * a + 1)"),
    "acosh": (E.acosh(_A + 1.5), "1 / sqrt((a + 1.5) * (a + 1.5) - 1)"), "atanh": (E.atanh(_A / 2.0), "0.5 / (1 - a * a / 4)"), "quot": (_A / (_A + _B), "b / ((a + b) * (a + b))"), "sig": (E.fast_inverse(E.exp(-_A) + 1.0), "exp(-a) / ((1 + exp(-a)) * (1 + exp(-a)))"),
    "rsq": (E.fast_inverse_sqrt(_A + 1.0), "-0.5 * pow(a + 1, -1.5)"), "sel": (E.select(_A > 0.5, _A * _A, _A * 3.0), "CASE WHEN a > 0.5 THEN 2 * a ELSE 3 END"), "mx": (E.max_(_A * 2.0, _B), "CASE WHEN 2 * a >= b THEN 2 ELSE 0 END"), "fl": (E.floor(_A * 9.0) * _A, "floor(a * 9)"),
}


@query("gradient_math", f"WITH p AS (SELECT p_partkey AS k, p_size / 60e0 AS a, p_retailprice / 1e3 + 1 AS b FROM part) SELECT k, {', '.join(f'round(CAST({s} AS DOUBLE), 6) + 0 AS {k}' for k, (_, s) in _GRAD.items())} FROM p")
def gradient_math(spark, d):
    p = grids.read(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 60.0).alias("a"), (F.col("p_retailprice") / 1e3 + 1).alias("b"))
    return p.select("k", *[(F.round(gradients(e, ["a"])["a"].column(), 6) + 0.0).alias(k) for k, (e, _) in _GRAD.items()])
