"""Queries over grids: reductions, scans, scatters, boundaries, stencils, contractions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.types import I64, U8
from ..operators import boundary, contract, pixels, reduce, resample, stencil
from ..plans.region import Range, box
from ..sources import grids
from ..operators.table import ArrayTable, domain

IMG = "img AS (SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CAST(least(255, floor(value / 2)) AS BIGINT) AS v FROM events)"
PRICE = "price AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
PART = "parts AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part)"
EMB = "emb AS (SELECT vec_id AS i, d, CAST(embedding[d + 1] AS DOUBLE) AS v FROM embeddings, (SELECT CAST(range AS INT) AS d FROM range(64)) r)"
#: Rows of the image; event ids run from 0 on without gaps.
HEIGHT = "h AS (SELECT max(y) + 1 AS h FROM img)"
QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


@query("hist_equalize", f"""WITH {IMG}, h AS (SELECT v AS bin, count(*) AS n FROM img GROUP BY v),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM h)
SELECT x, y, CAST(least(255, (c * 255) // t) AS BIGINT) AS v FROM img JOIN c ON img.v = c.bin""")
def hist_equalize(spark, d):
    return resample.equalize(grids.image(spark, d)).df


@query("histogram_1d", """WITH h AS (SELECT CAST(least(63, l_quantity) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(b.range AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(64) b LEFT JOIN h ON h.bin = b.range""")
def histogram_1d(spark, d):
    return reduce.histogram(grids.read(spark, d, "lineitem"), {"bin": (F.col("l_quantity").cast("int"), 64)})


@query("histogram_2d", f"""WITH {IMG}, h AS (SELECT x // 10 AS bx, v // 16 AS bv, count(*) AS n FROM img GROUP BY 1, 2)
SELECT CAST(a.range AS INT) AS bx, CAST(b.range AS INT) AS bv, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM range(10) a CROSS JOIN range(16) b LEFT JOIN h ON h.bx = a.range AND h.bv = b.range""")
def histogram_2d(spark, d):
    a = grids.image(spark, d)
    return reduce.histogram(a.df, {"bx": (F.floor(F.col("x") / 10), 10), "bv": (F.floor(F.col("v") / 16), 16)})


@query("rfactor_histogram", f"WITH {IMG} SELECT v AS bin, CAST(count(*) AS BIGINT) AS v FROM img GROUP BY img.v")
def rfactor_histogram(spark, d):
    a = grids.image(spark, d).df.select(F.col("v").alias("bin"), "y")
    return reduce.rfactor_sum(a, ["bin"], F.col("y") % 8, F.lit(1))


@query("reduce_basic", f"""WITH {IMG} SELECT y, CAST(sum(v) AS BIGINT) AS s, max(v) AS hi, min(v) AS lo, CAST(count(*) AS BIGINT) AS n,
CAST(sum(v * v) AS BIGINT) AS sq, CAST(least(255, sum(v)) AS BIGINT) AS sat, CAST(sum(v) % 65536 AS BIGINT) AS wrapped,
bool_and(v > 3) AS all_over, bool_or(v > 250) AS any_over, bit_and(v) AS ba, bit_or(v) AS bo, bit_xor(v) AS bx FROM img GROUP BY y""")
def reduce_basic(spark, d):
    v = F.col("v")
    from ..functions.types import U16

    return grids.image(spark, d).df.groupBy("y").agg(
        reduce.sum_(v).alias("s"), reduce.maximum(v, I64).alias("hi"), reduce.minimum(v, I64).alias("lo"), F.count("*").alias("n"),
        reduce.sum_(v * v).alias("sq"), reduce.saturating_sum(v, U8).cast("bigint").alias("sat"), reduce.sum_(v, U16).cast("bigint").alias("wrapped"),
        F.bool_and(v > 3).alias("all_over"), F.bool_or(v > 250).alias("any_over"), F.bit_and(v).alias("ba"), F.bit_or(v).alias("bo"), F.bit_xor(v).alias("bx"),
    )


@query("reduce_product", f"WITH {PART} SELECT k // 8 AS g, CAST(product(size) AS BIGINT) AS p FROM parts WHERE size < 20 GROUP BY 1")
def reduce_product(spark, d):
    return grids.parts(spark, d).where("size < 20").groupBy(F.call_function("div", F.col("k"), F.lit(8).cast("bigint")).alias("g")).agg(reduce.product(F.col("size")).alias("p"))


@query("reduce_empty", f"""WITH {IMG}, {HEIGHT}, g AS (SELECT y, sum(v) AS s, max(v) AS hi FROM img WHERE v > 241 GROUP BY y)
SELECT CAST(r.y AS INT) AS y, CAST(coalesce(s, 0) AS BIGINT) AS s, coalesce(hi, -1) AS hi FROM (SELECT unnest(range(h)) AS y FROM h) r LEFT JOIN g ON g.y = r.y""")
def reduce_empty(spark, d):
    a = grids.image(spark, d, region=True)
    return reduce.grouped(a.df.where("v > 241"), ["y"], [F.sum("v").alias("s"), F.max("v").alias("hi")], domain(spark, ["y"], (a.region[1],)), {"s": 0, "hi": -1})


@query("product_wrap", f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 1::HUGEINT AS p FROM img UNION ALL
SELECT t.y, i.x, (t.p * (2 * i.v + 3)) % 18446744073709551616 FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1)
SELECT y, CAST(CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END AS BIGINT) AS p FROM t WHERE x = 99""")
def product_wrap(spark, d):
    return reduce.product_by(grids.image(spark, d).df, ["y"], 2 * F.col("v") + 3, I64, "p")


@query("complex_product", f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 1e0 AS re, 0e0 AS im FROM img UNION ALL
SELECT t.y, i.x, t.re * cos(i.v / 50e0) - t.im * sin(i.v / 50e0), t.re * sin(i.v / 50e0) + t.im * cos(i.v / 50e0) FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1)
SELECT y, round(re, 7) AS re, round(im, 7) AS im FROM t WHERE x = 99""")
def complex_product(spark, d):
    angle = F.col("v") / 50.0
    got = reduce.complex_product_by(grids.image(spark, d).df, ["y"], F.cos(angle), F.sin(angle))
    return got.select("y", F.round("re", 7).alias("re"), F.round("im", 7).alias("im"))


@query("nan_extremes", f"""WITH {IMG}, f AS (SELECT y, CASE WHEN v > 240 AND y % 3 = 0 THEN 'nan'::DOUBLE ELSE v::DOUBLE END AS f FROM img)
SELECT y, CASE WHEN bool_or(isnan(f)) THEN NULL ELSE max(f) END AS hi, CASE WHEN bool_or(isnan(f)) THEN NULL ELSE min(f) END AS lo, max(f) FILTER (NOT isnan(f)) AS top FROM f GROUP BY y""")
def nan_extremes(spark, d):
    f = F.when((F.col("v") > 240) & (F.col("y") % 3 == 0), F.lit(float("nan"))).otherwise(F.col("v").cast("double"))
    got = grids.image(spark, d).df.select("y", f.alias("f")).groupBy("y")
    cols = {"hi": reduce.maximum_nan(F.col("f")), "lo": reduce.minimum_nan(F.col("f")), "top": reduce.maximum_number(F.col("f"))}
    return got.agg(*[c.alias(k) for k, c in cols.items()]).select("y", *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in cols])


@query("saturating_steps", f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 0 AS s FROM img UNION ALL
SELECT t.y, i.x, greatest(least(t.s + i.v - 120, 127), -128) FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1) SELECT y, CAST(s AS BIGINT) AS s FROM t WHERE x = 99""")
def saturating_steps(spark, d):
    from ..functions.types import I8

    got = grids.image(spark, d).df.groupBy("y").agg(reduce.saturating_fold(F.col("v") - 120, F.col("x"), I8).alias("s"))
    return got.select("y", F.col("s").cast("bigint").alias("s"))


@query("argmax_first", f"""WITH {EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, d) AS a, row_number() OVER (PARTITION BY i ORDER BY v, d) AS b FROM emb)
SELECT i, max(CASE WHEN a = 1 THEN d END) AS at_max, max(CASE WHEN a = 1 THEN v END) AS hi, max(CASE WHEN b = 1 THEN d END) AS at_min, max(CASE WHEN b = 1 THEN v END) AS lo FROM r GROUP BY i""")
def argmax_first(spark, d):
    g = grids.embedding(spark, d).df.groupBy("i").agg(reduce.argmax(F.col("v"), [F.col("d")]).alias("a"), reduce.argmin(F.col("v"), [F.col("d")]).alias("b"))
    return g.select("i", (-F.col("a.n0")).cast("int").alias("at_max"), F.col("a.v").alias("hi"), F.col("b.o0").cast("int").alias("at_min"), F.col("b.v").alias("lo"))


@query("predicated_rdom", f"WITH {IMG} SELECT y, CAST(sum(v) AS BIGINT) AS s FROM img WHERE x < y AND x % 3 = 1 GROUP BY y")
def predicated_rdom(spark, d):
    return grids.image(spark, d).df.where((F.col("x") < F.col("y")) & (F.col("x") % 3 == 1)).groupBy("y").agg(reduce.sum_(F.col("v")).alias("s"))


@query("tuple_reduction", f"WITH {IMG} SELECT x // 10 AS g, CAST(sum(v) AS BIGINT) AS re, CAST(sum(v * y) AS BIGINT) AS im, CAST(count(*) AS BIGINT) AS n FROM img GROUP BY 1")
def tuple_reduction(spark, d):
    return grids.image(spark, d).df.groupBy(F.floor(F.col("x") / 10).cast("int").alias("g")).agg(F.sum("v").alias("re"), F.sum(F.col("v") * F.col("y")).alias("im"), F.count("*").alias("n"))


@query("prefix_sum", f"WITH {PRICE} SELECT k, cents, CAST(sum(cents) OVER (ORDER BY k) AS BIGINT) AS v FROM price")
def prefix_sum(spark, d):
    return reduce.long_scan(grids.price(spark, d), "k", F.col("cents"), 4096)


@query("summed_area_table", f"""WITH {IMG}, r AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x) AS v FROM img)
SELECT x, y, CAST(sum(v) OVER (PARTITION BY x ORDER BY y) AS BIGINT) AS v FROM r""")
def summed_area_table(spark, d):
    return reduce.summed_area(grids.image(spark, d)).df


@query("running_max", f"WITH {IMG} SELECT x, y, max(v) OVER (PARTITION BY x ORDER BY y) AS v FROM img")
def running_max(spark, d):
    return reduce.scan(grids.image(spark, d), "y", F.max).df


@query("reverse_scan", f"WITH {IMG} SELECT x, y, CAST(sum(v) OVER (PARTITION BY y ORDER BY x DESC) AS BIGINT) AS v FROM img")
def reverse_scan(spark, d):
    return reduce.scan(grids.image(spark, d), "x", reverse=True).df


@query("moving_sum_max", f"""WITH {PRICE} SELECT k, CAST(sum(cents) OVER w AS BIGINT) AS s, max(cents) OVER w AS m FROM price
WINDOW w AS (ORDER BY k RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def moving_sum_max(spark, d):
    a = ArrayTable(grids.price(spark, d), ("k",), ("cents",), (I64,))
    return reduce.moving(a, "k", 3, 3, {"s": F.sum, "m": F.max}).df


@query("stream_compaction", f"WITH {PART} SELECT k, size, row_number() OVER (ORDER BY k) - 1 AS slot FROM parts WHERE size % 7 = 0 OR size % 5 = 0")
def stream_compaction(spark, d):
    return reduce.compact(grids.parts(spark, d), (F.col("size") % 7 == 0) | (F.col("size") % 5 == 0), "k", 500)


@query("scatter_last_wins", f"""WITH {PART} SELECT CAST(r.range AS BIGINT) AS size, coalesce(m, -1) AS v FROM range(64) r LEFT JOIN (SELECT size, max(k) AS m FROM parts GROUP BY size) g ON g.size = r.range""")
def scatter_last_wins(spark, d):
    init = spark.range(64).select(F.col("id").alias("size"), F.lit(-1).cast("bigint").alias("v"))
    return reduce.scatter(init, grids.parts(spark, d).select("size", F.col("k").alias("v"), F.col("k").alias("o")), ["size"], "v", ["o"])


@query("gather_lut", f"WITH {IMG}, {PART} SELECT x, y, size AS v FROM img JOIN parts ON parts.k = img.v")
def gather_lut(spark, d):
    lut = grids.parts(spark, d).where("k between 0 and 255").select(F.col("k").alias("v"), "size")
    return grids.image(spark, d).df.join(lut, "v").select("x", "y", F.col("size").alias("v"))


@query("iir_fold", f"""WITH RECURSIVE {IMG}, t AS (SELECT y, 0 AS x, v AS b FROM img WHERE x = 0 UNION ALL
SELECT t.y, i.x, (3 * t.b + i.v) // 4 FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1) SELECT y, x, CAST(b AS BIGINT) AS v FROM t""")
def iir_fold(spark, d):
    a = grids.image(spark, d)
    step = lambda acc, x: F.when(acc < 0, x).otherwise(F.floor((3 * acc + x) / 4))
    return reduce.fold(a.df, ["y"], "x", F.col("v"), F.lit(-1).cast("bigint"), step)


@query("iir_two_way", f"""WITH RECURSIVE {IMG}, f AS (SELECT y, -1 AS x, 0e0 AS b FROM (SELECT DISTINCT y FROM img) UNION ALL
SELECT f.y, i.x, 0.5e0 * f.b + 0.5e0 * i.v FROM f JOIN img i ON i.y = f.y AND i.x = f.x + 1),
g AS (SELECT y, 100 AS x, 0e0 AS b FROM (SELECT DISTINCT y FROM img) UNION ALL
SELECT g.y, f.x, 0.5e0 * g.b + 0.5e0 * f.b FROM g JOIN f ON f.y = g.y AND f.x = g.x - 1 AND f.x >= 0)
SELECT x, y, round(b, 6) AS v FROM g WHERE x < 100""")
def iir_two_way(spark, d):
    half = F.lit(0.5)
    there = reduce.affine_scan(grids.image(spark, d).df, ["y"], "x", F.col("v") * 0.5, half, block=32)
    back = reduce.affine_scan(there, ["y"], "x", F.col("v") * 0.5, half, block=32, reverse=True)
    return back.select("x", "y", F.round("v", 6).alias("v"))


@query("iir_columns", f"""WITH RECURSIVE {IMG}, f AS (SELECT x, -1 AS y, 0e0 AS b FROM range(100) t(x) UNION ALL
SELECT f.x, i.y, 0.75e0 * f.b + 0.25e0 * i.v FROM f JOIN img i ON i.x = f.x AND i.y = f.y + 1) SELECT CAST(x AS INT) AS x, y, round(b, 6) AS v FROM f WHERE y >= 0""")
def iir_columns(spark, d):
    return reduce.affine_scan(grids.image(spark, d).df, ["x"], "y", F.col("v") * 0.25, F.lit(0.75), block=64).select("x", "y", F.round("v", 6).alias("v"))


@query("fibonacci", "WITH RECURSIVE f AS (SELECT 0 AS x, CAST(1 AS BIGINT) AS v, CAST(1 AS BIGINT) AS w UNION ALL SELECT x + 1, w, v + w FROM f WHERE x < 39) SELECT x, v FROM f")
def fibonacci(spark, d):
    return spark.sql("WITH RECURSIVE f(x, v, w) AS (SELECT 0, CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT x + 1, w, v + w FROM f WHERE x < 39) SELECT x, v FROM f")


@query("extern_sort", f"WITH {IMG} SELECT y, row_number() OVER (PARTITION BY y ORDER BY v, x) - 1 AS slot, v FROM img")
def extern_sort(spark, d):
    return grids.image(spark, d).df.select("y", (F.row_number().over(Window.partitionBy("y").orderBy("v", "x")) - 1).cast("bigint").alias("slot"), "v")


def _boundary(name: str, kx: str, ky: str, f, sql: str | None = None):
    """The whole image, seen from 12 cells around it."""

    def run(spark, d):
        a = grids.image(spark, d, region=True)
        return f(a, [(-12, r.extent + 24) for r in a.region]).df

    QUERIES[name] = (run, f"""WITH {IMG}, {HEIGHT}, p AS (SELECT CAST(a.range - 12 AS INT) AS x, CAST(b.y - 12 AS INT) AS y, h.h FROM range(124) a CROSS JOIN (SELECT unnest(range(h + 24)) AS y FROM h) b CROSS JOIN h) """ + (sql or f"SELECT p.x, p.y, i.v FROM p JOIN img i ON i.x = {kx} AND i.y = {ky}"))


def _mirror(c: str, n: str) -> str:
    m = f"(({c} + 20 * {n}) % (2 * {n}))"
    return f"CASE WHEN {m} >= {n} THEN 2 * {n} - 1 - {m} ELSE {m} END"


_boundary("bc_repeat_edge", "greatest(least(p.x, 99), 0)", "greatest(least(p.y, h - 1), 0)", boundary.repeat_edge)
_boundary("bc_repeat_image", "(p.x + 100) % 100", "(p.y + 20 * h) % h", boundary.repeat_image)
_boundary("bc_mirror_image", _mirror("p.x", "100"), _mirror("p.y", "h"), boundary.mirror_image)
_boundary("bc_mirror_interior", "99 - abs((p.x + 1980) % 198 - 99)", "h - 1 - abs((p.y + 40 * (h - 1)) % (2 * (h - 1)) - (h - 1))", boundary.mirror_interior)
_boundary("bc_constant_exterior", "", "", lambda a, r: boundary.constant_exterior(a, -5, r), "SELECT p.x, p.y, coalesce(i.v, -5) AS v FROM p LEFT JOIN img i ON i.x = p.x AND i.y = p.y")


def _near(offsets, expr: str, dims: str = "x, y") -> str:
    """SQL of a neighbourhood: one join, a case for each offset."""
    cells = ", ".join(f"max(CASE WHEN b.x - a.x = {i} AND b.y - a.y = {j} THEN b.v END) AS c{k}" for k, (i, j) in enumerate(offsets))
    pairs = ", ".join(f"({i}, {j})" for i, j in offsets)
    return f"""WITH {IMG}, o(i, j) AS (VALUES {pairs}), a AS (SELECT DISTINCT img.x - o.i AS x, img.y - o.j AS y FROM img, o),
n AS (SELECT a.x, a.y, {cells}, count(*) AS k FROM a, o, img b WHERE b.x = a.x + o.i AND b.y = a.y + o.j GROUP BY a.x, a.y)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST({expr} AS BIGINT) AS v FROM n WHERE k = {len(offsets)}"""


_SQ = stencil.square(1)
_AT = {o: f"c{k}" for k, o in enumerate(_SQ)}
_GX = f"({_AT[1, -1]} + 2 * {_AT[1, 0]} + {_AT[1, 1]} - {_AT[-1, -1]} - 2 * {_AT[-1, 0]} - {_AT[-1, 1]})"
_GY = f"({_AT[-1, 1]} + 2 * {_AT[0, 1]} + {_AT[1, 1]} - {_AT[-1, -1]} - 2 * {_AT[0, -1]} - {_AT[1, -1]})"
for _name, _f, _sql in (
    ("sobel", stencil.sobel, _near(_SQ, f"least(abs({_GX}) + abs({_GY}), 255)")),
    ("dilate3x3", stencil.dilate3, _near(_SQ, "greatest(" + ", ".join(_AT.values()) + ")")),
    ("erode3x3", stencil.erode3, _near(_SQ, "least(" + ", ".join(_AT.values()) + ")")),
    ("median3x3", stencil.median3, _near(_SQ, "list_sort([" + ", ".join(_AT.values()) + "])[5]")),
    ("conv3x3", lambda a: stencil.correlate(a, {o: (k % 3) - 1 for k, o in enumerate(_SQ)}), _near(_SQ, " + ".join(f"{k % 3 - 1} * c{k}" for k in range(9)))),
    ("stencil5x5_u16", stencil.stencil5_u16, _near(stencil.square(2), "(" + " + ".join(f"c{k}" for k in range(25)) + ") % 65536")),
    ("gaussian5x5", stencil.gaussian5, _near(stencil.square(2), "(" + " + ".join(f"{stencil.BINOMIAL5[k % 5] * stencil.BINOMIAL5[k // 5]} * c{k}" for k in range(25)) + ") // 256")),
    ("max_filter_disc", lambda a: stencil.max_disc(a, 2), _near([o for o in stencil.square(2) if o[0] ** 2 + o[1] ** 2 <= 5], "greatest(" + ", ".join(f"c{k}" for k in range(21)) + ")")),
):
    QUERIES[_name] = ((lambda spark, d, f=_f: f(grids.image(spark, d)).df), _sql)

_THIRD = "SELECT a.x, a.y, (a.v + b.v + c.v) // 3 AS v FROM {t} a JOIN {t} b ON b.x = a.x + {i} AND b.y = a.y + {j} JOIN {t} c ON c.x = a.x + 2 * {i} AND c.y = a.y + 2 * {j}"


@query("blur3x3", f"WITH {IMG}, h AS ({_THIRD.format(t='img', i=1, j=0)}) {_THIRD.format(t='h', i=0, j=1)}")
def blur3x3(spark, d):
    return stencil.box_blur3(grids.image(spark, d)).df


@query("harris_int", f"""WITH g AS (SELECT x, y, v // 1 AS v FROM (SELECT 1 AS x, 1 AS y, 1 AS v)), {IMG}, o(i, j) AS (VALUES {', '.join(map(str, _SQ))}),
gr AS (SELECT b.x - o.i AS x, b.y - o.j AS y, sum(b.v * o.i * (2 - abs(o.j))) AS gx, sum(b.v * o.j * (2 - abs(o.i))) AS gy, count(*) AS n FROM img b, o GROUP BY 1, 2),
s AS (SELECT gr.x - o.i AS x, gr.y - o.j AS y, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy, count(*) AS n FROM gr, o WHERE gr.n = 9 GROUP BY 1, 2)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(xx * yy - xy * xy - floor((xx + yy) * (xx + yy) / 25) AS BIGINT) AS v FROM s WHERE n = 9""")
def harris_int(spark, d):
    return stencil.harris(grids.image(spark, d)).df


@query("downsample2x", f"WITH {IMG} SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(sum(v) // count(*) AS BIGINT) AS v FROM img GROUP BY 1, 2")
def downsample2x(spark, d):
    return resample.downsample(grids.image(spark, d)).df


@query("upsample2x", f"WITH {IMG} SELECT CAST(2 * x + a.range AS INT) AS x, CAST(2 * y + b.range AS INT) AS y, v FROM img CROSS JOIN range(2) a CROSS JOIN range(2) b")
def upsample2x(spark, d):
    return resample.upsample(grids.image(spark, d)).df


@query("laplacian_level", f"""WITH {IMG}, l AS (SELECT x // 2 AS x, y // 2 AS y, sum(v) // count(*) AS v FROM img GROUP BY 1, 2)
SELECT img.x, img.y, CAST(img.v - l.v AS BIGINT) AS v FROM img JOIN l ON l.x = img.x // 2 AND l.y = img.y // 2""")
def laplacian_level(spark, d):
    return resample.laplacian_level(grids.image(spark, d)).df


@query("resize_linear", f"""WITH {IMG}, t AS (SELECT y, o.range AS x, greatest(1 - abs((s.x - ((o.range + 0.5) / 0.5 - 0.5)) * 0.5), 0.0) AS w, v FROM img s CROSS JOIN range(50) o WHERE abs(s.x - ((o.range + 0.5) / 0.5 - 0.5)) < 2)
SELECT y, CAST(x AS INT) AS x, round(sum(w * v) / sum(w), 6) AS v FROM t WHERE w > 0 GROUP BY y, x""")
def resize_linear(spark, d):
    out = resample.resize_1d(grids.image(spark, d), "x", 0.5, 50, "linear").df
    return out.select("y", "x", F.round("v", 6).alias("v"))


@query("haar_x", f"""WITH {IMG}, g AS (SELECT x // 2 AS x, y, sum(v) AS s, sum(CASE WHEN x % 2 = 1 THEN -v ELSE v END) AS e FROM img GROUP BY 1, 2)
SELECT CAST(x AS INT) AS x, y, CAST(c.range AS INT) AS c, CAST(CASE WHEN c.range = 0 THEN s ELSE e END AS BIGINT) AS v FROM g CROSS JOIN range(2) c""")
def haar_x(spark, d):
    return resample.haar(grids.image(spark, d)).df


@query("inverse_haar_x", f"WITH {IMG} SELECT x, y, v FROM img")
def inverse_haar_x(spark, d):
    return resample.inverse_haar(resample.haar(grids.image(spark, d))).df


@query("daubechies_round_trip", f"WITH {IMG} SELECT x, y, CAST(v AS DOUBLE) AS v FROM img WHERE x BETWEEN 2 AND 97")
def daubechies_round_trip(spark, d):
    out = resample.inverse_daubechies(resample.daubechies(grids.image(spark, d))).df
    return out.select("x", "y", F.round("v", 6).alias("v"))


def _grid_blur(axis: str, t: str) -> str:
    rest = [a for a in ("gx", "gy", "gz") if a != axis]
    return f"SELECT {', '.join(rest)}, {axis} + o.k AS {axis}, sum(n * o.w) AS n, sum(total * o.w) AS total FROM {t}, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) o(k, w) GROUP BY ALL"


@query("bilateral_grid", f"""WITH {IMG}, g AS (SELECT x // 8 AS gx, y // 8 AS gy, v * 8 // 256 AS gz, count(*) AS n, sum(v) AS total FROM img GROUP BY 1, 2, 3),
g1 AS ({_grid_blur('gx', 'g')}), g2 AS ({_grid_blur('gy', 'g1')}), g3 AS ({_grid_blur('gz', 'g2')})
SELECT x, y, CAST(total // n AS BIGINT) AS v FROM img JOIN g3 ON gx = x // 8 AND gy = y // 8 AND gz = v * 8 // 256""")
def bilateral_grid(spark, d):
    return resample.bilateral_filter(grids.image(spark, d), 8, 8).df


_EASY = {
    "transpose": (lambda a: a.transpose(), "SELECT y AS x, x AS y, v FROM img"),
    "crop": (lambda a: a.crop("x", 5, 20).crop("y", 3, 9), "SELECT x, y, v FROM img WHERE x BETWEEN 5 AND 24 AND y BETWEEN 3 AND 11"),
    "translate": (lambda a: a.translate("x", -7).translate("y", 3), "SELECT x - 7 AS x, y + 3 AS y, v FROM img"),
    "slice": (lambda a: a.slice("y", 4), "SELECT x, v FROM img WHERE y = 4"),
    "embed": (lambda a: a.embed("c", 2, 3), "SELECT x, y, 3 AS c, v FROM img"),
    "deinterleave": (lambda a: a.deinterleave("x"), "SELECT CAST(x // 2 AS INT) AS x, y, CAST(x % 2 AS INT) AS c, v FROM img"),
    "interleave": (lambda a: a.interleave(a.map(v=F.col("v") + 1), "x"), "SELECT 2 * x + c.range::INT AS x, y, v + c.range AS v FROM img CROSS JOIN range(2) c"),
    "fill": (lambda a: a.fill(9), "SELECT x, y, CAST(9 AS BIGINT) AS v FROM img"),
    "copy_from": (lambda a: a.copy_from(a.crop("x", 0, 30).map(v=F.col("v") * 2)), "SELECT x, y, CASE WHEN x < 30 THEN 2 * v ELSE v END AS v FROM img"),
    "for_each_value": (lambda a: a.for_each_value(lambda p, q: p * q, a), "SELECT x, y, v * v AS v FROM img"),
}
for _name, (_f, _sql) in _EASY.items():
    QUERIES[_name] = ((lambda spark, d, f=_f: f(grids.image(spark, d)).df), f"WITH {IMG} {_sql}")


@query("concat", f"WITH {IMG} SELECT x, y, v FROM img UNION ALL SELECT x + 100, y, v + 1 FROM img")
def concat(spark, d):
    a = grids.image(spark, d)
    a = a._with(a.df, region=(Range(0, 100), Range(0, 1 << 20)))
    return a.concat(a.map(v=F.col("v") + 1), "x").df


def _matrix(spark, d, names: tuple[str, str]):
    """The whole image as a matrix, a row a line."""
    return grids.image(spark, d).df.select(F.col("y").alias(names[0]), F.col("x").alias(names[1]), "v")


def _square(spark, names: tuple[str, str]):
    """A matrix of 100 x 100 small numbers."""
    return domain(spark, list(names), box(100, 100)).withColumn("v", (F.pmod(F.col(names[0]) * 7 + F.col(names[1]) * 3, F.lit(11)) - 5).cast("bigint"))


_AB = f"{IMG}, a AS (SELECT y AS i, x AS k, v FROM img), b AS (SELECT k.range AS k, CAST(j.range AS INT) AS j, (k.range * 7 + j.range * 3) % 11 - 5 AS v FROM range(100) k, range(100) j)"


@query("matmul_int", f"WITH {_AB} SELECT i, j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY i, j")
def matmul_int(spark, d):
    return contract.matmul(_matrix(spark, d, ("i", "k")), _square(spark, ("k", "j")))


@query("matmul_blocked", f"WITH {_AB} SELECT i, j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY i, j")
def matmul_blocked(spark, d):
    return contract.matmul(_matrix(spark, d, ("i", "k")), _square(spark, ("k", "j")), block=25)


@query("gemm", f"WITH {_AB} SELECT i, j, CAST(2 * sum(a.v * b.v) + 3 * max(c.v) AS BIGINT) AS v FROM a JOIN b USING (k) JOIN (SELECT y AS i, x AS j, v FROM img) c USING (i, j) GROUP BY i, j")
def gemm(spark, d):
    b = contract.transposed(_square(spark, ("k", "j")), "k", "j")
    return contract.gemm(_matrix(spark, d, ("i", "k")), b, _matrix(spark, d, ("i", "j")), 2, 3, trans_b=True)


@query("gemm_trans_a", f"WITH {IMG}, a AS (SELECT y AS i, x AS j, v FROM img) SELECT CAST(p.j AS INT) AS i, CAST(q.j AS INT) AS j, CAST(2 * sum(p.v * q.v) + 3 * max((p.j * 7 + q.j * 3) % 11 - 5) AS BIGINT) AS v FROM a p JOIN a q USING (i) GROUP BY p.j, q.j")
def gemm_trans_a(spark, d):
    return contract.gemm(_matrix(spark, d, ("i", "k")), _matrix(spark, d, ("k", "j")), _square(spark, ("i", "j")), 2, 3, trans_a=True)


_V = f"{_AB}, p AS (SELECT CAST(range AS INT) AS i, range * 5 % 17 - 8 AS v FROM range(100)), q AS (SELECT y AS i, v FROM img WHERE x = 6)"


def _vec(spark):
    return spark.range(100).select(F.col("id").cast("int").alias("i"), (F.col("id") * 5 % 17 - 8).alias("v"))


def _column(spark, d):
    """A column of the image: as long as the image is high."""
    return grids.image(spark, d).slice("x", 6).df.select(F.col("y").alias("i"), "v")


@query("gemv", f"WITH {_V} SELECT q.i, CAST(2 * sum(a.v * p.v) + max(q.v) AS BIGINT) AS v FROM q JOIN a ON a.i = q.i JOIN p ON p.i = a.k GROUP BY q.i")
def gemv(spark, d):
    return contract.gemv(_matrix(spark, d, ("i", "k")), _vec(spark), _column(spark, d), 2, 1)


@query("ger", f"WITH {_V} SELECT a.i, a.k AS j, a.v + 3 * q.v * p.v AS v FROM a JOIN q ON q.i = a.i JOIN p ON p.i = a.k")
def ger(spark, d):
    return contract.ger(_matrix(spark, d, ("i", "j")), _column(spark, d), _vec(spark), 3)


@query("blas_level1", f"WITH {IMG}, p AS (SELECT y * 100 + x AS i, v FROM img), q AS (SELECT i, v * 3 % 256 AS v FROM p) SELECT CAST(sum(p.v * q.v) AS BIGINT) AS dot, CAST(sum(abs(p.v)) AS BIGINT) AS asum, CAST(sum(4 * p.v + q.v) AS BIGINT) AS axpy, CAST(sum(7 * p.v) AS BIGINT) AS scal FROM p JOIN q USING (i)")
def blas_level1(spark, d):
    p = grids.image(spark, d).df.select((F.col("y") * 100 + F.col("x")).alias("i"), "v")
    q = p.withColumn("v", F.pmod(F.col("v") * 3, F.lit(256)))
    out = contract.dot(p, q).select(F.col("v").alias("dot"))
    for name, df in (("asum", contract.asum(p)), ("axpy", contract.axpy(p, q, 4).agg(F.sum("v").alias("v"))), ("scal", contract.scal(p, 7).agg(F.sum("v").alias("v")))):
        out = out.join(F.broadcast(df.select(F.col("v").alias(name))))  # one row each
    return out


@query("conv_layer", f"""WITH {IMG}, dt AS (SELECT 0 AS n, y, x // 4 AS x, x % 4 AS ci, v FROM img), w AS (SELECT co.range AS co, ky.range AS ky, kx.range AS kx, ci.range AS ci, (co.range + 2 * ky.range - kx.range + ci.range) % 5 - 2 AS w FROM range(3) co, range(3) ky, range(3) kx, range(4) ci)
SELECT CAST(n AS INT) AS n, CAST(dt.y - w.ky AS INT) AS y, CAST(dt.x - w.kx AS INT) AS x, CAST(co AS INT) AS co, CAST(greatest(0, sum(v * w) + 10 * co) AS BIGINT) AS v FROM dt JOIN w USING (ci) GROUP BY 1, 2, 3, co HAVING count(*) = 36""")
def conv_layer(spark, d):
    data = grids.image(spark, d).df.select(F.lit(0).alias("n"), "y", F.floor(F.col("x") / 4).cast("int").alias("x"), F.pmod("x", F.lit(4)).alias("ci"), "v")
    w = domain(spark, ["co", "ky", "kx", "ci"], box(3, 3, 3, 4)).withColumn("v", (F.col("co") + 2 * F.col("ky") - F.col("kx") + F.col("ci")) % 5 - 2)
    bias = spark.range(3).select(F.col("id").cast("int").alias("c"), (F.col("id") * 10).alias("v"))
    return contract.conv2d(data, w, bias)


@query("dft_rows", f"WITH {IMG} SELECT y, x, CAST(v AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im FROM img")
def dft_rows(spark, d):
    rows = grids.image(spark, d).df.select("y", F.col("x").alias("i"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    back = contract.fft(contract.fft(rows, 100, ["y"]), 100, ["y"], inverse=True)
    return back.select("y", F.col("i").alias("x"), F.round("re", 4).alias("re"), F.round(F.abs("im"), 4).alias("im"))


_DFT = f"""{IMG}, {HEIGHT}, r AS (SELECT y, CAST(f.range AS INT) AS fx, sum(v * cos(-2 * pi() * ((x * f.range) % 100) / 100)) AS re, sum(v * sin(-2 * pi() * ((x * f.range) % 100) / 100)) AS im FROM img, range(51) f GROUP BY 1, 2),
g AS (SELECT CAST(unnest(range(h)) AS INT) AS fy, h FROM h),
c AS (SELECT fx, fy, sum(re * cos(-2 * pi() * ((y * fy) % h) / h) - im * sin(-2 * pi() * ((y * fy) % h) / h)) AS re, sum(re * sin(-2 * pi() * ((y * fy) % h) / h) + im * cos(-2 * pi() * ((y * fy) % h) / h)) AS im FROM r, g GROUP BY 1, 2)"""


@query("fft2_real", f"WITH {_DFT} SELECT fx AS x, fy AS y, round(re, 3) + 0 AS re, round(im, 3) + 0 AS im FROM c")
def fft2_real(spark, d):
    a = grids.image(spark, d, region=True)
    out = contract.fft2_real(a.df, a.region[0].extent, a.region[1].extent)
    return out.select("x", "y", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query("fft2_round_trip", f"WITH {IMG} SELECT x, y, v::DOUBLE AS v FROM img")
def fft2_round_trip(spark, d):
    a = grids.image(spark, d, region=True)
    w, h = a.region[0].extent, a.region[1].extent
    return contract.fft2_to_real(contract.fft2_real(a.df, w, h), w, h).select("x", "y", F.round("v", 4).alias("v"))


for _rule, (_t, _l) in {"over": ("255", "(255 - a)"), "atop": ("b", "(255 - a)"), "xor": ("(255 - b)", "(255 - a)"), "in": ("b", "0"), "out": ("(255 - b)", "0")}.items():

    def _composite(spark, d, rule=_rule):
        alpha, low = F.pmod(F.col("x") * 3 + F.col("y"), F.lit(256)), F.pmod(F.col("x") * 5, F.lit(256))
        v, a = pixels.composite(rule, (F.least("v", alpha), alpha), (F.least(255 - F.col("v"), low), low))
        return grids.image(spark, d).df.select("x", "y", v.cast("bigint").alias("v"), a.cast("bigint").alias("alpha"))

    QUERIES[f"composite_{_rule}"] = (_composite, f"""WITH {IMG}, l AS (SELECT x, y, (x * 3 + y) % 256 AS a, (x * 5) % 256 AS b, least(v, (x * 3 + y) % 256) AS t, least(255 - v, (x * 5) % 256) AS u FROM img)
SELECT x, y, CAST(least(255, (t * {_t} + 127) // 255 + (u * {_l} + 127) // 255) AS BIGINT) AS v, CAST(least(255, (a * {_t} + 127) // 255 + (b * {_l} + 127) // 255) AS BIGINT) AS alpha FROM l""")


@query("game_of_life", None)
def game_of_life(spark, d):
    a = grids.image(spark, d, region=True)
    return stencil.life(a.map(v=F.col("v") % 2), 2).df


def _life_sql() -> str:
    step = """SELECT g.x, g.y, CASE WHEN sum(n.v) - max(CASE WHEN n.x = g.x AND n.y = g.y THEN n.v END) = 3 OR (sum(n.v) - max(CASE WHEN n.x = g.x AND n.y = g.y THEN n.v END) = 2 AND max(CASE WHEN n.x = g.x AND n.y = g.y THEN n.v END) = 1) THEN 1 ELSE 0 END AS v
FROM {t} g CROSS JOIN o CROSS JOIN h JOIN {t} n ON n.x = (g.x + o.i + 100) % 100 AND n.y = (g.y + o.j + h.h) % h.h GROUP BY g.x, g.y"""
    return f"WITH {IMG}, h AS (SELECT max(y) + 1 AS h FROM img), o(i, j) AS (VALUES {', '.join(map(str, _SQ))}), g0 AS (SELECT x, y, v % 2 AS v FROM img), g1 AS ({step.format(t='g0')}), g2 AS ({step.format(t='g1')}) SELECT x, y, CAST(v AS BIGINT) AS v FROM g2"


QUERIES["game_of_life"] = (game_of_life, _life_sql())


@query("pool_max_avg", f"WITH {IMG} SELECT CAST(x // 3 AS INT) AS x, CAST(y // 3 AS INT) AS y, max(v) AS m, CAST((sum(v) + count(*) // 2) // count(*) AS BIGINT) AS a FROM img GROUP BY 1, 2")
def pool_max_avg(spark, d):
    return pixels.pools(grids.image(spark, d).df, {"m": "max", "a": "avg"}, 3, 3, [])


@query("softmax_l2", f"WITH {EMB}, m AS (SELECT i, max(v) AS m, sqrt(sum(v * v)) AS l FROM emb GROUP BY i), s AS (SELECT emb.i, sum(exp(v - m.m)) AS s FROM emb JOIN m USING (i) GROUP BY 1) SELECT i, d, round(exp(v - m.m) / s.s, 8) AS p, round(v / l, 8) AS u FROM emb JOIN m USING (i) JOIN s USING (i)")
def softmax_l2(spark, d):
    e = grids.embedding(spark, d).df.withColumn("u", F.col("v"))
    return pixels.l2_normalize(pixels.softmax(e, ["i"]), ["i"], "u").select("i", "d", F.round("v", 8).alias("p"), F.round("u", 8).alias("u"))


@query("tensor_reductions", f"WITH {EMB} SELECT i, round(sum(v), 6) AS s, round(sum(abs(v)), 6) AS l1, round(sqrt(sum(v * v)), 6) AS l2, round(ln(sum(exp(v))), 6) AS lse, round(avg(v), 6) AS m FROM emb GROUP BY i")
def tensor_reductions(spark, d):
    v, r = F.col("v"), pixels.REDUCE
    names = {"s": "ReduceSum", "l1": "ReduceL1", "l2": "ReduceL2", "lse": "ReduceLogSumExp", "m": "ReduceMean"}
    return grids.embedding(spark, d).df.groupBy("i").agg(*[F.round(r[op](v), 6).alias(k) for k, op in names.items()])


@query("tensor_shapes", f"WITH {EMB} SELECT CAST(i AS INT) AS i, CAST(d // 8 AS INT) AS a, CAST(d % 8 AS INT) AS b, round(v, 6) AS v FROM emb")
def tensor_shapes(spark, d):
    e = grids.embedding(spark, d).df
    n = e.agg(F.max("i")).first()[0] + 1
    return pixels.reshape(e, [("i", n), ("d", 64)], [("i", n), ("a", 8), ("b", 8)]).withColumn("v", F.round("v", 6))


@query("activations", f"WITH {EMB} SELECT i, d, round(greatest(v, 0), 8) AS relu, round(1 / (1 + exp(-v)), 8) AS sigmoid, round(CASE WHEN v < 0 THEN exp(v) - 1 ELSE v END, 8) AS elu, round(CASE WHEN v < 0 THEN 0.01 * v ELSE v END, 8) AS leaky, round(greatest(least(v, 0.5), -0.5), 8) AS clip FROM emb")
def activations(spark, d):
    v = F.col("v")
    cols = {"relu": pixels.UNARY["Relu"](v), "sigmoid": pixels.UNARY["Sigmoid"](v), "elu": pixels.ACTIVATIONS["Elu"](v), "leaky": pixels.ACTIVATIONS["LeakyRelu"](v), "clip": pixels.ACTIVATIONS["Clip"](v, min=-0.5, max=0.5)}
    return grids.embedding(spark, d).df.select("i", "d", *[F.round(c, 8).alias(k) for k, c in cols.items()])


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, CAST(greatest(least(floor(value / 32), 15), 0) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming import events

    return events.windowed_histogram(grids.read(spark, d, "events"))


_NL = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]


@query("nl_means", f"""WITH {IMG}, o(k, i, j) AS (VALUES {', '.join(f'({k}, {i}, {j})' for k, (i, j) in enumerate(_NL))}),
m AS (SELECT a.x, a.y, o.k, b.v::DOUBLE AS u, (a.v - b.v) * (a.v - b.v)::DOUBLE AS d FROM img a, o, img b WHERE b.x = a.x + o.i AND b.y = a.y + o.j),
s AS (SELECT m.x - o.i AS x, m.y - o.j AS y, m.k, sum(m.d) AS d FROM m, o GROUP BY 1, 2, 3)
SELECT m.x, m.y, round(sum(exp(-s.d / 8100e0) * m.u) / sum(exp(-s.d / 8100e0)), 5) AS v FROM m JOIN s ON s.x = m.x AND s.y = m.y AND s.k = m.k GROUP BY 1, 2""")
def nl_means(spark, d):
    return stencil.nl_means(grids.image(spark, d), 1, 1, 30.0).df.select("x", "y", F.round("v", 5).alias("v"))
