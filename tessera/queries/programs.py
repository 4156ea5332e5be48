"""Image programs, tensor operators and derivatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.types import F64
from ..operators import pixels, vision
from ..plans.autodiff import gradients, propagate_adjoints, scatter_adjoint
from ..plans.func import Func, Image, RDom, Var
from ..plans.region import box
from ..operators.table import ArrayTable
from ..sources import grids
from .arrays import EMB, IMG, _near
from ..operators.stencil import BINOMIAL5, square

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


_G = _near(square(2), "(" + " + ".join(f"{BINOMIAL5[k % 5] * BINOMIAL5[k // 5]} * c{k}" for k in range(25)) + ") // 256")


@query("unsharp", f"WITH g AS ({_G}), {IMG} SELECT img.x, img.y, CAST(greatest(least(img.v + (img.v - g.v), 255), 0) AS BIGINT) AS v FROM img JOIN g ON g.x = img.x AND g.y = img.y")
def unsharp(spark, d):
    return vision.unsharp(grids.image(spark, d)).df


@query("stereo_depth", f"""WITH {IMG}, c AS (SELECT a.x, a.y, s.range AS s, abs(a.v - b.v) AS c FROM img a CROSS JOIN range(4) s JOIN img b ON b.x = a.x - s.range AND b.y = a.y),
w AS (SELECT c.x - o.i AS x, c.y - o.j AS y, s, sum(c) AS c, count(*) AS n FROM c, (VALUES {', '.join(map(str, square(1)))}) o(i, j) GROUP BY 1, 2, s),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY c, s) AS k FROM w WHERE n = 9) SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, s AS v, CAST(c AS BIGINT) AS cost FROM r WHERE k = 1""")
def stereo_depth(spark, d):
    a = grids.image(spark, d)
    return vision.stereo_depth(a, a, 4, 1).df


@query("demosaic_green", f"""WITH {IMG} SELECT a.x, a.y, CAST(CASE WHEN (a.x + a.y) % 2 = 0 THEN a.v ELSE (l.v + r.v + t.v + b.v) // 4 END AS BIGINT) AS v FROM img a
JOIN img l ON l.x = a.x - 1 AND l.y = a.y JOIN img r ON r.x = a.x + 1 AND r.y = a.y JOIN img t ON t.x = a.x AND t.y = a.y - 1 JOIN img b ON b.x = a.x AND b.y = a.y + 1""")
def demosaic_green(spark, d):
    return vision.demosaic(grids.image(spark, d)).df


@query("color_matrix", f"""WITH {IMG}, p AS (SELECT x, y, v AS r, 255 - v AS g, (v * 7) % 256 AS b FROM img)
SELECT x, y, CAST(greatest(least(floor((300 * r - 30 * g - 14 * b + 10) / 256.0), 255), 0) AS BIGINT) AS r, CAST(greatest(least(floor((-20 * r + 290 * g - 10 * b - 40) / 256.0), 255), 0) AS BIGINT) AS g, CAST(greatest(least(floor((5 * r - 60 * g + 310 * b) / 256.0), 255), 0) AS BIGINT) AS b FROM p""")
def color_matrix(spark, d):
    v = F.col("v")
    out = vision.color_matrix({"r": v, "g": 255 - v, "b": F.pmod(v * 7, F.lit(256))}, [[300, -30, -14, 10], [-20, 290, -10, -40], [5, -60, 310, 0]])
    return grids.image(spark, d).df.select("x", "y", *[c.alias(k) for k, c in out.items()])


@query("local_laplacian", f"""WITH {IMG}, k AS (SELECT range AS k FROM range(8)), b0 AS (SELECT x, y, k, v + CAST(floor((v - k * 32) * 2 / 8.0) AS BIGINT) AS v FROM img, k),
b1 AS (SELECT x // 2 AS x, y // 2 AS y, k, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM b0 GROUP BY ALL), g1 AS (SELECT x // 2 AS x, y // 2 AS y, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM img GROUP BY ALL)
SELECT i.x, i.y, CAST(b0.v - b1.v + g1.v AS BIGINT) AS v FROM img i JOIN b0 ON b0.x = i.x AND b0.y = i.y AND b0.k = least(i.v // 32, 7) JOIN b1 ON b1.x = i.x // 2 AND b1.y = i.y // 2 AND b1.k = b0.k JOIN g1 ON g1.x = i.x // 2 AND g1.y = i.y // 2""")
def local_laplacian(spark, d):
    return vision.local_laplacian(grids.image(spark, d), 2, 8, 2).df


@query("grid_fit", f"""WITH {IMG}, g AS (SELECT x // 10 AS gx, y // 10 AS gy, count(*) AS n, sum(v) AS sa, sum(2 * v + x) AS sb, sum(v * v) AS aa, sum(v * (2 * v + x)) AS ab FROM img GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n * aa - sa * sa = 0 THEN 0.0 ELSE CAST(n * ab - sa * sb AS DOUBLE) / CAST(n * aa - sa * sa AS DOUBLE) END AS slope FROM g)
SELECT x, y, round(slope * v + (CAST(sb AS DOUBLE) - slope * sa) / n, 5) AS v FROM img JOIN s ON gx = x // 10 AND gy = y // 10""")
def grid_fit(spark, d):
    df = grids.image(spark, d).df.select("x", "y", F.col("v").alias("a"), (2 * F.col("v") + F.col("x")).alias("b"))
    return vision.grid_apply(df, vision.grid_fit(df, 10), 10).select("x", "y", F.round("v", 5).alias("v"))


@query("srgb_curves", f"WITH {IMG} SELECT x, y, round(CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END, 9) AS lin, round(CASE WHEN v / 255.0 <= 0.0031308 THEN v / 255.0 * 12.92 ELSE 1.055 * pow(v / 255.0, 1 / 2.4) - 0.055 END, 9) AS enc FROM img")
def srgb_curves(spark, d):
    v = F.col("v") / 255.0
    return grids.image(spark, d).df.select("x", "y", F.round(pixels.srgb_to_linear(v), 9).alias("lin"), F.round(pixels.linear_to_srgb(v), 9).alias("enc"))


@query("quantized_ops", f"""WITH {IMG}, p AS (SELECT x, y, v AS a, (v * 3) % 256 AS b FROM img)
SELECT x, y, CAST(greatest(least(((a - 12) * 90 + (b - 20) * 70 + 64) // 128 + 5 - CASE WHEN ((a - 12) * 90 + (b - 20) * 70 + 64) % 128 < 0 THEN 1 ELSE 0 END, 255), 0) AS BIGINT) AS s,
CAST(greatest(least(((a - 12) * (b - 20) * 3 + 512) // 1024 + 9 - CASE WHEN ((a - 12) * (b - 20) * 3 + 512) % 1024 < 0 THEN 1 ELSE 0 END, 255), 0) AS BIGINT) AS m FROM p""")
def quantized_ops(spark, d):
    a, b = F.col("v"), F.pmod(F.col("v") * 3, F.lit(256))
    return grids.image(spark, d).df.select("x", "y", pixels.quantized_add(a, b, 12, 20, 90, 70, 7, 5).alias("s"), pixels.quantized_mul(a, b, 12, 20, 3, 10, 9).alias("m"))


@query("space_depth", f"WITH {IMG} SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST((y % 2) * 2 + x % 2 AS INT) AS c, v FROM img")
def space_depth(spark, d):
    return pixels.space_to_depth(grids.image(spark, d).df.withColumn("c", F.lit(0)), 2, 1)


@query("depth_space", f"WITH {IMG} SELECT x, y, CAST(0 AS INT) AS c, v FROM img")
def depth_space(spark, d):
    return pixels.depth_to_space(pixels.space_to_depth(grids.image(spark, d).df.withColumn("c", F.lit(0)), 2, 1), 2, 1)


@query("tensor_index", f"WITH {EMB}, n AS (SELECT max(i) + 1 AS n FROM emb), g AS (SELECT unnest(range(n)) AS g, n FROM n) SELECT CAST(g AS BIGINT) AS i, d, round(v, 6) AS v FROM g JOIN emb ON emb.i = (g * 3) % n")
def tensor_index(spark, d):
    e = grids.embedding(spark, d).df
    n = e.agg(F.max("i")).first()[0] + 1
    index = spark.range(n).select(F.col("id").alias("i"), F.pmod(F.col("id") * 3, F.lit(n)).alias("v"))
    return pixels.gather(e, index, "i").select("i", "d", F.round("v", 6).alias("v"))


@query("tensor_binary", f"WITH {EMB}, m AS (SELECT d, avg(v) AS m FROM emb GROUP BY d) SELECT i, emb.d, round(v - m, 6) AS v FROM emb JOIN m ON m.d = emb.d")
def tensor_binary(spark, d):
    e = grids.embedding(spark, d).df
    mean = pixels.reduce_axes(e, "ReduceMean", ["d"])
    return pixels.binary(e, mean, "Sub", ["d"]).select("i", "d", F.round("v", 6).alias("v"))


@query("one_hot", "SELECT CAST(p_partkey AS BIGINT) AS i, CAST(k.range AS INT) AS k, CAST(CASE WHEN k.range = p_size % 4 THEN 1 ELSE 0 END AS DOUBLE) AS v FROM part CROSS JOIN range(4) k")
def one_hot(spark, d):
    return pixels.one_hot(grids.parts(spark, d).select(F.col("k").alias("i"), (F.col("size") % 4).alias("v")), 4)


@query("gradient", "SELECT p_partkey AS k, round(2 * p_size * p_retailprice + cos(p_size), 6) AS da, round(CAST(p_size * p_size AS DOUBLE) - 1 / p_retailprice, 6) AS db FROM part")
def gradient(spark, d):
    a, b = E.col("a", F64), E.col("b", F64)
    g = gradients(a * a * b + E.sin(a) - E.log(b), ["a", "b"])
    p = grids.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return p.select("k", F.round(g["a"].column(), 6).alias("da"), F.round(g["b"].column(), 6).alias("db"))


@query("gradient_gather", f"WITH {IMG} SELECT CAST(v AS INT) AS place, CAST(sum(2 * x) AS DOUBLE) AS adj FROM img GROUP BY v")
def gradient_gather(spark, d):
    reads = grids.image(spark, d).df.select(F.col("v").cast("int").alias("place"), (2.0 * F.col("x")).alias("adj"))
    return scatter_adjoint(reads, ["place"], "adj")


@query("adjoint_blur", f"""WITH {IMG}, h AS (SELECT max(y) + 1 AS h FROM img), o AS (SELECT x, y, (2e0 * a.v + 3e0 * b.v * b.v) AS f, a.v AS va, b.v AS vb FROM img a JOIN (SELECT x - 1 AS x, y, v FROM img) b USING (x, y)),
s AS (SELECT x, y, 2e0 * (x + 1) AS g FROM o UNION ALL SELECT x + 1, y, 6e0 * vb * (x + 1) FROM o) SELECT CAST(x AS INT) AS x, y, round(sum(g), 4) AS v FROM s GROUP BY 1, 2""")
def adjoint_blur(spark, d):
    """Of 2 a + 3 b^2 over neighbours a and b, a stage of its own, weighted by x + 1 and
    summed along rows by an update: what each input point adds to the total."""
    a = grids.image(spark, d, region=True)
    img = Image(a._with(a.df.withColumn("v", F.col("v").cast("double")), types=(F64,)), 2, F64)
    x, y, w, h = Var("x"), Var("y"), a.width, a.height
    mixed, total, r = Func("mixed"), Func("total"), RDom([(0, w - 1)])
    mixed[x, y] = img[x, y] * 2.0 + img[x + 1, y] * img[x + 1, y] * 3.0
    mixed.compute_root()
    total[y] = E.const(0.0, F64)
    total[y] += mixed[r.x, y] * E.cast(F64, r.x + 1)
    ones = spark.range(h).select(F.col("id").cast("int").alias("y"), F.lit(1.0).alias("v"))
    found = propagate_adjoints(total, ArrayTable(ones, ("y",), ("v",), (F64,), box(h)), spark)
    return found[img].df.select("x", "y", F.round("v", 4).alias("v"))


@query("adjoint_lookup", f"WITH {IMG}, t AS (SELECT v // 16 AS k, count(*) AS n, sum(x) AS s FROM img GROUP BY 1) SELECT CAST(k AS INT) AS k, round(2e0 * (k / 4e0) * s, 5) AS v FROM t")
def adjoint_lookup(spark, d):
    """Of the square of a table read at a computed place: sums over all its readers."""
    a = grids.image(spark, d, region=True)
    img = Image(a, 2)
    lut = Image(ArrayTable(spark.range(16).select(F.col("id").cast("int").alias("k"), (F.col("id") / 4.0).alias("v")), ("k",), ("v",), (F64,), box(16)), 1, F64)
    x, y, f = Var("x"), Var("y"), Func("read")
    e = lut[E.clamp(E.i32(img[x, y] / 16), 0, 15)]
    f[x, y] = e * e
    weight = a.df.select("x", "y", F.col("x").cast("double").alias("v"))
    found = propagate_adjoints(f, ArrayTable(weight, ("x", "y"), ("v",), (F64,), a.region), spark)
    return found[lut].df.select("k", F.round("v", 5).alias("v"))
