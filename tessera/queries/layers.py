"""Iterated points, recurrent and normalizing layers, filled-in images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract, pixels, recurrent, resample
from ..operators.table import domain
from ..plans.region import box
from ..sources import grids
from .arrays import IMG

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


@query("mandelbrot", """WITH RECURSIVE t AS (SELECT a.range AS x, b.range AS y, 0 AS k, 0e0 AS re, 0e0 AS im, 0 AS n FROM range(48) a, range(32) b UNION ALL
SELECT x, y, k + 1, CASE WHEN re * re + im * im < 4e0 THEN re * re - im * im + (x / 16e0 - 2e0) ELSE re END, CASE WHEN re * re + im * im < 4e0 THEN 2e0 * re * im + (y / 16e0 - 1e0) ELSE im END, n + CASE WHEN re * re + im * im < 4e0 THEN 1 ELSE 0 END FROM t WHERE k < 12)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(n AS INT) AS iters FROM t WHERE k = 12""")
def mandelbrot(spark, d):
    cr, ci = F.col("x") / 16.0 - 2.0, F.col("y") / 16.0 - 1.0

    def step(s):
        inside = s["re"] * s["re"] + s["im"] * s["im"] < 4.0
        return {
            "re": F.when(inside, s["re"] * s["re"] - s["im"] * s["im"] + cr).otherwise(s["re"]),
            "im": F.when(inside, 2.0 * s["re"] * s["im"] + ci).otherwise(s["im"]),
            "iters": s["iters"] + inside.cast("int"),
        }

    start = {"re": F.lit(0.0), "im": F.lit(0.0), "iters": F.lit(0)}
    return recurrent.iterate(domain(spark, ["x", "y"], box(48, 32)), start, 12, step).select("x", "y", "iters")


@query("newton_roots", """WITH RECURSIVE t AS (SELECT o_orderkey AS k, o_totalprice AS a, 0 AS n, o_totalprice AS r FROM orders UNION ALL SELECT k, a, n + 1, (r + a / r) / 2e0 FROM t WHERE n < 20)
SELECT k, round(r, 6) AS root FROM t WHERE n = 20""")
def newton_roots(spark, d):
    rows = grids.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    found = recurrent.iterate(rows, {"r": F.col("a")}, 20, lambda s: {"r": (s["r"] + F.col("a") / s["r"]) / 2.0})
    return found.select("k", F.round("r", 6).alias("root"))


def _weights(gates: int) -> tuple[list[list[float]], list[list[float]], list[float]]:
    """Two units, one input."""
    n = 2 * gates
    return [[0.5 + 0.25 * (k % 3)] for k in range(n)], [[0.125 * (k % 4) - 0.25, 0.375 - 0.125 * (k % 5)] for k in range(n)], [0.0625 * k - 0.125 for k in range(n)]


def _layer_sql(kind: str) -> str:
    """One step after another along each row of the image."""
    w, r, b = _weights(len(recurrent.GATES[kind]))
    at = {g: 2 * i for i, g in enumerate(recurrent.GATES[kind])}

    def pre(g, j, h=("t.h0", "t.h1")):
        k = at[g] + j
        return f"({w[k][0]}e0 * (i.v / 256e0) + {r[k][0]}e0 * {h[0]} + {r[k][1]}e0 * {h[1]} + {b[k]}e0)"

    def sigmoid(e):
        return f"(1e0 / (1e0 + exp(-{e})))"

    if kind == "rnn":
        h, c = [f"tanh({pre('h', j)})" for j in (0, 1)], ["0e0", "0e0"]
    elif kind == "gru":
        reset = [f"({sigmoid(pre('r', j))} * t.h{j})" for j in (0, 1)]
        h = [f"(1e0 - {sigmoid(pre('z', j))}) * tanh({pre('h', j, reset)}) + {sigmoid(pre('z', j))} * t.h{j}" for j in (0, 1)]
        c = ["0e0", "0e0"]
    else:
        c = [f"({sigmoid(pre('f', j))} * t.c{j} + {sigmoid(pre('i', j))} * tanh({pre('c', j)}))" for j in (0, 1)]
        h = [f"{sigmoid(pre('o', j))} * tanh({c[j]})" for j in (0, 1)]
    return f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 0e0 AS h0, 0e0 AS h1, 0e0 AS c0, 0e0 AS c1 FROM img UNION ALL
SELECT t.y, i.x, {h[0]}, {h[1]}, {c[0]}, {c[1]} FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1)
SELECT y, x, round(h0, 6) AS h0, round(h1, 6) AS h1 FROM t WHERE x >= 0"""


def _layer(kind: str):
    def run(spark, d):
        series = grids.image(spark, d).df.select("y", "x", F.array(F.col("v") / 256.0).alias("v"))
        found = recurrent.recurrent(series, ["y"], "x", kind, *_weights(len(recurrent.GATES[kind])), x="v")
        return found.select("y", "x", *[F.round(F.col("h")[j], 6).alias(f"h{j}") for j in (0, 1)])

    return run


for _kind in recurrent.GATES:
    QUERIES[f"{_kind}_rows"] = (_layer(_kind), _layer_sql(_kind))


@query("pull_push", f"""WITH {IMG}, a AS (SELECT x, y, CASE WHEN v % 3 = 0 THEN v ELSE 0 END AS v, CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END AS w FROM img),
b AS (SELECT x // 2 AS x, y // 2 AS y, sum(v) / 4e0 AS v, sum(w) / 4e0 AS w FROM a GROUP BY 1, 2),
c AS (SELECT a.x, a.y, a.v + (1 - a.w) * b.v AS v, a.w + (1 - a.w) * b.w AS w FROM a JOIN b ON b.x = a.x // 2 AND b.y = a.y // 2)
SELECT x, y, round(CASE WHEN w > 0 THEN v / w ELSE 0 END, 5) AS v FROM c""")
def pull_push(spark, d):
    a = grids.image(spark, d)
    weighted = a._with(a.df.withColumn("w", (F.col("v") % 3 == 0).cast("int")))
    return resample.pull_push(weighted, 2).df.select("x", "y", F.round("v", 5).alias("v"))


@query("depthwise_conv", f"""WITH {IMG}, dt AS (SELECT y, x // 4 AS x, x % 4 AS ci, v FROM img), w AS (SELECT ci.range AS ci, ky.range AS ky, kx.range AS kx, (2 * ci.range + 2 * ky.range - kx.range) % 5 - 2 AS w FROM range(4) ci, range(3) ky, range(3) kx)
SELECT 0 AS n, CAST(dt.y - w.ky AS INT) AS y, CAST(dt.x - w.kx AS INT) AS x, CAST(ci AS INT) AS co, CAST(greatest(0, sum(v * w) + 10 * ci) AS BIGINT) AS v FROM dt JOIN w USING (ci) GROUP BY 2, 3, ci HAVING count(*) = 9""")
def depthwise_conv(spark, d):
    data = grids.image(spark, d).df.select(F.lit(0).alias("n"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), F.pmod("x", F.lit(4)).alias("ci"), "v")
    w = domain(spark, ["ci", "ky", "kx"], box(4, 3, 3)).withColumn("co", F.col("ci")).withColumn("v", (2 * F.col("ci") + 2 * F.col("ky") - F.col("kx")) % 5 - 2)
    bias = spark.range(4).select(F.col("id").cast("int").alias("c"), (F.col("id") * 10).alias("v"))
    return contract.conv2d(data, w, bias, groups=True)


@query("batch_norm", f"""WITH {IMG}, s AS (SELECT x % 4 AS c, avg(v) AS m, var_pop(v) AS s FROM img GROUP BY 1)
SELECT x, y, round((v - m) / sqrt(s + 1e-5) * 2e0 + 1e0, 5) AS v FROM img JOIN s ON c = x % 4""")
def batch_norm(spark, d):
    df = grids.image(spark, d).df.withColumn("c", F.pmod("x", F.lit(4)))
    stats = df.groupBy("c").agg(F.lit(2.0).alias("scale"), F.lit(1.0).alias("bias"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    return pixels.batch_norm(df, stats, "c").select("x", "y", F.round("v", 5).alias("v"))


@query("lrn", f"""WITH {IMG} SELECT x, y, round(v / pow(1e0 + 1e-4 / 5 * sum(v * v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0.75e0), 5) AS v FROM img""")
def lrn(spark, d):
    return pixels.lrn(grids.image(spark, d).df, ["y"], "x", 5, 1e-4, 0.75, 1.0).select("x", "y", F.round("v", 5).alias("v"))
