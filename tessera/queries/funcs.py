"""Array programs in the function front end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.types import I32, I64, U8, U32
from ..operators.table import generate
from ..plans.extern import Extern, extern
from ..plans.func import Callable_, Func, Image, Param, RDom, Var, _, inline_maximum, inline_sum
from ..plans.generator import Generator, Input, Output, Parameter
from ..sources import grids
from .arrays import IMG

QUERIES: dict[str, tuple] = {}


class ScaleAndAdd(Generator):
    """scale * v + offset at each point."""

    scale_type = Parameter(I64)
    image = Input(2)
    result = Output(2)

    def configure(self):
        self.scale = Param(self.scale_type, min=0, max=100)
        self.offset = Param(self.scale_type)

    def generate(self):
        a, b = Var("x"), Var("y")
        self.result[a, b] = E.cast(self.scale_type, self.image[a, b]) * self.scale + self.offset


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _image(spark, d) -> Image:
    """The whole image, its region known."""
    return Image(grids.image(spark, d, region=True), 2, I64)


def _size(img: Image) -> tuple[int, int]:
    return tuple(r.extent for r in img.table.region)


def _small(spark) -> Image:
    """100 x 100 small numbers."""
    v = (F.pmod(F.col("x") * 7 + F.col("y") * 3, F.lit(11)) - 5)
    return Image(generate(spark, ("x", "y"), [100, 100], v, I64), 2, I64)


x, y = Var("x"), Var("y")


@query("func_blur", f"""WITH {IMG}, h AS (SELECT a.x, a.y, (a.v + b.v + c.v) // 3 AS v FROM img a JOIN img b ON b.x = a.x + 1 AND b.y = a.y JOIN img c ON c.x = a.x + 2 AND c.y = a.y)
SELECT a.x, a.y, CAST((a.v + b.v + c.v) // 3 AS BIGINT) AS v FROM h a JOIN h b ON b.x = a.x AND b.y = a.y + 1 JOIN h c ON c.x = a.x AND c.y = a.y + 2""")
def func_blur(spark, d):
    img, bx, by = _image(spark, d), Func("bx"), Func("by")
    w, h = _size(img)
    bx[x, y] = (img[x, y] + img[x + 1, y] + img[x + 2, y]) / 3
    by[x, y] = (bx[x, y] + bx[x, y + 1] + bx[x, y + 2]) / 3
    bx.compute_root()
    return by.realize([w - 2, h - 2], spark).df


_TAPS = [(i, j) for j in range(-2, 3) for i in range(-2, 3)]


@query("func_stencil5x5", f"WITH {IMG}, o(i, j) AS (VALUES {', '.join(map(str, _TAPS))}) SELECT a.x, a.y, CAST(sum(b.v * (o.i + 3) * (o.j + 4)) AS BIGINT) AS v FROM img a, o, img b WHERE b.x = a.x + o.i AND b.y = a.y + o.j GROUP BY 1, 2 HAVING count(*) = 25")
def func_stencil5x5(spark, d):
    """25 reads of one array: one exchange."""
    img, f = _image(spark, d), Func("st")
    w, h = _size(img)
    e = E.const(0, I64)
    for i, j in _TAPS:
        e = e + img[x + i, y + j] * ((i + 3) * (j + 4))
    f[x, y] = e
    return f.realize([(2, w - 4), (2, h - 4)], spark).df


@query("func_histogram", f"""WITH {IMG}, h AS (SELECT v // 16 AS b, count(*) AS n FROM img WHERE x < 2 * y GROUP BY 1)
SELECT CAST(r.range AS INT) AS b, CAST(coalesce(n, 0) AS INT) AS v FROM range(16) r LEFT JOIN h ON h.b = r.range""")
def func_histogram(spark, d):
    img, h, b = _image(spark, d), Func("h"), Var("b")
    r = RDom([(0, n) for n in _size(img)])
    r.where(r.x < 2 * r.y)
    h[b] = 0
    h[E.clamp(E.i32(img[r.x, r.y] / 16), 0, 15)] += 1
    return h.realize([16], spark).df


@query("func_rfactor", f"WITH {IMG} SELECT y, CAST(sum(v * (x + 1)) AS BIGINT) AS v FROM img WHERE (x + y) % 3 > 0 GROUP BY y")
def func_rfactor(spark, d):
    """A sum along rows in two steps: for each of ten columns of tens, then of those."""
    img, f, u = _image(spark, d), Func("rf"), Var("u")
    w, h = _size(img)
    r = RDom([(0, 10), (0, w // 10)])
    at = r.y * 10 + r.x
    r.where((at + y) % 3 > 0)
    f[y] = E.const(0, I64)
    f[y] += img[at, y] * E.i64(at + 1)
    f.rfactor({r.y: u})
    return f.realize([h], spark).df


@query("func_multiply", f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 1::HUGEINT AS p FROM img UNION ALL
SELECT t.y, i.x, (t.p * (2 * i.v + 1)) % 4294967296 FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1)
SELECT y, CAST(CASE WHEN p >= 2147483648 THEN p - 4294967296 ELSE p END AS INT) AS v FROM t WHERE x = 99""")
def func_multiply(spark, d):
    """32-bit products of whole rows, which wrap; the first definition is implied."""
    img, f = _image(spark, d), Func("ml")
    w, h = _size(img)
    r = RDom([(0, w)])
    f[y] *= E.i32(img[r.x, y]) * 2 + 1
    return f.realize([h], spark).df


@query("func_bits", f"WITH {IMG} SELECT y, bit_and(v + 300) AS bt_0, bit_or(v) AS bt_1, bit_xor(v) AS bt_2 FROM img GROUP BY y")
def func_bits(spark, d):
    img, f = _image(spark, d), Func("bt")
    w, h = _size(img)
    r = RDom([(0, w)])
    v = img[r.x, y]
    f[y] = (E.const(-1, I64), E.const(0, I64), E.const(0, I64))
    f[y] = (f[y][0] & (v + 300), f[y][1] | v, f[y][2] ^ v)
    return f.realize([h], spark).df


@query("func_divide", f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 1000000000::BIGINT AS p FROM img UNION ALL
SELECT t.y, i.x, t.p // (i.v % 3 + 1) FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1) SELECT y, p AS v FROM t WHERE x = 99""")
def func_divide(spark, d):
    """Whole-number quotients one after another: steps on one place, in order."""
    img, f = _image(spark, d), Func("dv")
    w, h = _size(img)
    r = RDom([(0, w)])
    f[y] = E.const(1_000_000_000, I64)
    f[y] /= img[r.x, y] % 3 + 1
    return f.realize([h], spark).df


@query("func_complex", f"""WITH RECURSIVE {IMG}, t AS (SELECT DISTINCT y, -1 AS x, 1::BIGINT AS a, 0::BIGINT AS b FROM img UNION ALL
SELECT t.y, i.x, (t.a * (i.v % 5) - t.b * (i.v % 7) + 1048576) % 1009 - 504, (t.a * (i.v % 7) + t.b * (i.v % 5) + 1048576) % 1009 - 504 FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1)
SELECT y, a AS cx_0, b AS cx_1 FROM t WHERE x = 99""")
def func_complex(spark, d):
    """A tuple whose parts need each other's last values."""
    img, f = _image(spark, d), Func("cx")
    w, h = _size(img)
    r = RDom([(0, w)])
    re, im = img[r.x, y] % 5, img[r.x, y] % 7
    f[y] = (E.const(1, I64), E.const(0, I64))
    a, b = f[y]
    f[y] = ((a * re - b * im + (1 << 20)) % 1009 - 504, (a * im + b * re + (1 << 20)) % 1009 - 504)
    return f.realize([h], spark).df


@query("func_cdf", "SELECT CAST(range AS INT) AS x, CAST(range * (range + 1) // 2 AS INT) AS v FROM range(64)")
def func_cdf(spark, d):
    f, r = Func("cdf"), RDom([(1, 63)])
    f[x] = x
    f[r.x] = f[r.x - 1] + f[r.x]
    return f.realize([64], spark).df


@query("func_scan_rows", f"WITH {IMG} SELECT x, y, CAST(sum(v) OVER (PARTITION BY y ORDER BY x) AS BIGINT) AS v FROM img")
def func_scan_rows(spark, d):
    img, f = _image(spark, d), Func("s")
    w, h = _size(img)
    r = RDom([(1, w - 1)])
    f[x, y] = img[x, y]
    f[r.x, y] = f[r.x, y] + f[r.x - 1, y]
    return f.realize([w, h], spark).df


@query("func_scan_2d", f"WITH {IMG}, r AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x) AS v FROM img) SELECT x, y, CAST(sum(v) OVER (PARTITION BY x ORDER BY y) AS BIGINT) AS v FROM r")
def func_scan_2d(spark, d):
    """A summed-area table by one update over both coordinates, which reads three places
    that it has stored before."""
    img, f = _image(spark, d), Func("sa")
    w, h = _size(img)
    r = RDom([(0, w), (0, h)])
    f[x, y] = E.select(E.logical_and(x >= 0, y >= 0), img[E.clamp(x, 0, w - 1), E.clamp(y, 0, h - 1)], E.const(0, I64))
    f[r.x, r.y] = f[r.x, r.y] + f[r.x - 1, r.y] + f[r.x, r.y - 1] - f[r.x - 1, r.y - 1]
    return f.realize([w, h], spark).df


@query("func_predicated_scan", f"""WITH RECURSIVE {IMG}, t AS (SELECT x, y, v AS s FROM img WHERE x = 0 UNION ALL
SELECT i.x, i.y, CASE WHEN i.v % 2 = 0 THEN t.s + i.v ELSE i.v END FROM t JOIN img i ON i.y = t.y AND i.x = t.x + 1) SELECT x, y, CAST(s AS BIGINT) AS v FROM t""")
def func_predicated_scan(spark, d):
    """Sums of runs: a recurrence within a predicate on the data."""
    img, f = _image(spark, d), Func("ps")
    w, h = _size(img)
    r = RDom([(1, w - 1)])
    r.where(img[r.x, y] % 2 == 0)
    f[x, y] = img[x, y]
    f[r.x, y] = f[r.x, y] + f[r.x - 1, y]
    return f.realize([w, h], spark).df


@query("recursive_box", f"""WITH {IMG} SELECT x, y, CAST(sum(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS rb_0,
CAST(sum(v) OVER (PARTITION BY y ORDER BY x) AS BIGINT) AS rb_1 FROM img""")
def recursive_box(spark, d):
    """A moving sum by its recurrence: what enters and what leaves, beside a running sum."""
    img, f = _image(spark, d), Func("rb")
    w, h = _size(img)
    r = RDom([(0, w)])
    padded = Func("pad")
    padded[x, y] = E.select(x >= 0, img[E.clamp(x, 0, w - 1), y], E.const(0, I64))
    f[x, y] = (E.const(0, I64), E.const(0, I64))
    f[r.x, y] = (f[r.x - 1, y][0] + padded[r.x, y] - padded[r.x - 5, y], f[r.x - 1, y][1] + padded[r.x, y])
    return f.realize([w, h], spark).df


@query("func_scatter", "SELECT CAST(range AS INT) AS x, CAST(CASE WHEN range % 3 = 0 AND range < 30 THEN range // 3 * 10 ELSE -1 END AS INT) AS v FROM range(40)")
def func_scatter(spark, d):
    f, r = Func("sc"), RDom([(0, 10)])
    f[x] = -1
    f[r.x * 3] = r.x * 10
    return f.realize([40], spark).df


@query("func_swap", f"WITH {IMG} SELECT x, y, CASE WHEN x = 0 THEN max(v) FILTER (x = 99) OVER (PARTITION BY y) WHEN x = 99 THEN max(v) FILTER (x = 0) OVER (PARTITION BY y) ELSE v END AS v FROM img")
def func_swap(spark, d):
    """Both ends of every row change places: a scatter that reads before it writes."""
    img, f = _image(spark, d), Func("sw")
    w, h = _size(img)
    f[x, y] = img[x, y]
    f[E.scatter(0, w - 1), y] = E.gather(f[w - 1, y], f[0, y])
    return f.realize([w, h], spark).df


@query("func_undef", f"WITH {IMG} SELECT x, y, CASE WHEN x = 7 AND v > 100 THEN -v ELSE v END AS ud_0, CASE WHEN x = 7 THEN y ELSE 0 END AS ud_1 FROM img")
def func_undef(spark, d):
    """Guarded stores, and a tuple of which only one part is stored."""
    img, f = _image(spark, d), Func("ud")
    f[x, y] = (img[x, y], E.const(0))
    f[7, y] = (E.select(f[7, y][0] > 100, -f[7, y][0], f[7, y][0]), E.undef(I32))
    f[7, y] = (E.undef(I64), y)
    return f.realize(_size(img), spark).df


@query("func_wrappers", f"WITH {IMG} SELECT x - 3 AS x, y + 2 AS y, 2 * v + 1 AS v FROM img WHERE x > 2")
def func_wrappers(spark, d):
    """Pure calls of calls, a wrapper, an implied definition of all coordinates, a region
    that does not begin at zero, and directives that change nothing."""
    img, f, g, k = _image(spark, d), Func("wf"), Func("wg"), Func("wk")
    w, h = _size(img)
    f[x, y] = img[x + 3, y - 2]
    g[x, y] = f[x, y]
    k[_] = g.in_()[_] * 2 + 1
    a, b = (E.Expr(I32, name=n) for n in k.args)
    xo, xi = Var(), Var()
    for one in (f, g, k):
        one.split(x, xo, xi, 8).tile(x, y, 8, 8).fuse(x, y, xo).reorder(y, x).vectorize(x, 8).parallel(y).unroll(x, 2).atomic().prefetch(img, x, 2)
        one.compute_with(one).async_().ring_buffer(2).stream_loads().trace_loads().no_profiling().set_estimate(x, 0, w).align_bounds(x, 8).partition(x)
    g.compute_at(k, b).store_root().memoize()
    k.bound(a, 0, w - 3).specialize(E.const(w) > 0)
    k.specialize_fail("never")
    k.add_requirement(E.const(h) > 0)
    out = k.realize([(0, w - 3), (2, h)], spark).df
    return out.select(F.col(k.args[0]).alias("x"), F.col(k.args[1]).alias("y"), "v")


@query("func_params", f"WITH {IMG} SELECT x, y, v * 3 + 7 AS v FROM img")
def func_params(spark, d):
    """A generated pipeline with parameters that are set after it was built."""
    img = _image(spark, d)
    made = ScaleAndAdd(scale_type=I64)
    made.offset.set(7)
    made.scale.set(3)
    return made(_size(img), spark, img.table).df


@query("func_change_type", f"WITH {IMG} SELECT y, CAST(sum(v) % 256 AS INT) AS narrow, CAST(sum(v) AS BIGINT) AS wide FROM img GROUP BY y")
def func_change_type(spark, d):
    """Sums in 8 bits, accumulated at 32 bits, are the same; and what 64 bits hold."""
    img, f, g = _image(spark, d), Func("n8"), Func("n64")
    w, h = _size(img)
    r = RDom([(0, w)])
    f[y] = E.const(0, U8)
    f[y] += E.u8(img[r.x, y])
    g[y] += img[r.x, y]
    a = f.change_type(U32).realize([h], spark).df.select("y", F.col("v").cast("int").alias("narrow"))
    return a.join(g.realize([h], spark).df.select("y", F.col("v").alias("wide")), "y")


@query("func_extern", f"WITH {IMG}, s AS (SELECT y, list_sort(list(v)) AS l FROM img GROUP BY y) SELECT CAST(unnest(range(100)) AS INT) AS x, y, unnest(l) AS v, unnest(list_reverse(l)) AS down FROM s")
def func_extern(spark, d):
    """A black box with two outputs that asks for whole rows of its input."""
    img = _image(spark, d)

    def sorted_rows(frame):
        frame = frame.sort_values("v")
        return frame.assign(x=range(len(frame)), down=frame["v"].to_numpy()[::-1])[["x", "y", "v", "down"]].astype({"x": "int32"})

    box_ = Extern(sorted_rows, ("x", "y"), (I64, I64), outputs=("v", "down"), groups=("y",), needs=lambda out: [(0, 100), out[1]])
    return box_.realize([100, _size(img)[1]], spark, img).df


@query("func_extern_call", f"WITH {IMG} SELECT x, y, CAST(v * 2 + length(v::VARCHAR) AS BIGINT) AS v FROM img")
def func_extern_call(spark, d):
    """Registered scalar functions inside an expression."""
    digits = extern("digits", I64, lambda c: F.length(c.cast("string")))
    img, f = _image(spark, d), Func("ec")
    f[x, y] = img[x, y] * 2 + digits(img[x, y])
    return f.realize(_size(img), spark).df


@query("func_frames", f"WITH {IMG} SELECT CAST(k.range AS INT) AS t, x, y, v + k.range AS v FROM img CROSS JOIN range(3) k")
def func_frames(spark, d):
    """One pipeline called for frame after frame with other inputs."""
    img = grids.image(spark, d, region=True)
    slot, f = Image(img, 2, I64), Func("fr")
    f[x, y] = slot[x, y]
    call = Callable_(f, slot)
    parts = [call([r.extent for r in img.region], spark, img.map(v=F.col("v") + t)).df.select(F.lit(t).alias("t"), "x", "y", "v") for t in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("func_upsample", f"WITH {IMG} SELECT CAST(r.range AS INT) AS x, y, v FROM range(200) r JOIN img ON img.x = r.range // 2")
def func_upsample(spark, d):
    img, f = _image(spark, d), Func("up")
    w, h = _size(img)
    f[x, y] = img[x / 2, y]
    return f.realize([2 * w, h], spark).df


@query("func_tuple", f"WITH {IMG} SELECT x, y, v + 1 AS tp_0, CAST(v > 100 AS INT) AS tp_1 FROM img")
def func_tuple(spark, d):
    img, f = _image(spark, d), Func("tp")
    f[x, y] = (img[x, y] + 1, E.select(img[x, y] > 100, E.const(1), E.const(0)))
    return f.realize(_size(img), spark).df


@query("func_matmul", f"WITH {IMG}, b AS (SELECT k.range AS k, CAST(j.range AS INT) AS j, (j.range * 7 + k.range * 3) % 11 - 5 AS v FROM range(100) k, range(100) j) SELECT b.j AS x, a.y, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM img a JOIN b ON b.k = a.x GROUP BY 1, 2")
def func_matmul(spark, d):
    img, b, f, r = _image(spark, d), _small(spark), Func("mm"), RDom([(0, 100)])
    f[x, y] = inline_sum(r, img[r.x, y] * b[x, r.x])
    return f.realize([100, _size(img)[1]], spark).df


@query("func_maximum", f"WITH {IMG} SELECT x, max(v) AS v FROM img GROUP BY x")
def func_maximum(spark, d):
    img, f = _image(spark, d), Func("mx")
    w, h = _size(img)
    r = RDom([(0, h)])
    f[x] = inline_maximum(r, img[x, r.x])
    return f.realize([w], spark).df


@query("func_gather", f"WITH {IMG} SELECT a.x, a.y, b.v FROM img a JOIN img b ON b.x = a.v % 100 AND b.y = a.y")
def func_gather(spark, d):
    img, f = _image(spark, d), Func("ga")
    f[x, y] = img[E.i32(img[x, y] % 100), y]
    return f.realize(_size(img), spark).df


@query("func_custom_pass", f"WITH {IMG} SELECT x, y, v * 8 + 1 AS v FROM img")
def func_custom_pass(spark, d):
    """A pass over the tree that writes shifts for a product."""
    img, f = _image(spark, d), Func("cp")
    f[x, y] = img[x, y] * 8 + 1
    f.add_custom_lowering_pass(lambda e: e.rebuild(lambda n: n.args[0] << 3 if n.tag == "mul" and n.args[1].value == 8 else None))
    return f.realize(_size(img), spark).df
