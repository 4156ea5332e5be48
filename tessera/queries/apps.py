"""Whole image programs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import resample, stencil, vision
from ..operators.pixels import COMPOSITE
from ..sources import grids
from .arrays import IMG

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def _rounded(a, digits: int):
    return a.df.select("x", "y", F.round("v", digits).alias("v"))


def _weights(radius: int, sigma: float) -> str:
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return f"w(k, w) AS (VALUES {', '.join(f'({k}, {v / sum(raw)!r}::DOUBLE)' for k, v in zip(range(-radius, radius + 1), raw))})"


def _gauss(t: str, n: int) -> str:
    return f"gh AS (SELECT b.x - w.k AS x, b.y, sum(b.v * w.w) AS v FROM {t} b, w GROUP BY 1, 2 HAVING count(*) = {n}), gv AS (SELECT b.x, b.y - w.k AS y, sum(b.v * w.w) AS v FROM gh b, w GROUP BY 1, 2 HAVING count(*) = {n})"


@query("gaussian_radius", f"WITH {IMG}, {_weights(4, 1.7)}, {_gauss('img', 9)} SELECT x, y, round(v, 5) AS v FROM gv")
def gaussian_radius(spark, d):
    return _rounded(vision.gaussian(grids.image(spark, d), 4, 1.7), 5)


@query("unsharp_ratio", f"WITH {IMG}, g AS (SELECT x, y, v + 1e0 AS v FROM img), {_weights(3, 1.5)}, {_gauss('g', 7)} SELECT g.x, g.y, round((g.v - 1) * (2 * g.v - gv.v) / g.v, 5) AS v FROM g JOIN gv USING (x, y)")
def unsharp_ratio(spark, d):
    return _rounded(vision.unsharp_ratio(grids.image(spark, d), 3, 1.5), 5)


_SQ2 = ", ".join(map(str, stencil.square(2)))
_CHAIN = "SELECT b.x - o.i AS x, b.y - o.j AS y, sum(b.v) % 65536 AS v FROM {t} b, o GROUP BY 1, 2 HAVING count(*) = 25"


@query("stencil_chain", f"WITH {IMG}, o(i, j) AS (VALUES {_SQ2}), a AS ({_CHAIN.format(t='img')}) SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(v AS BIGINT) AS v FROM ({_CHAIN.format(t='a')})")
def stencil_chain(spark, d):
    return vision.stencil_chain(grids.image(spark, d), 2).df


_SQ1 = ", ".join(map(str, stencil.square(1)))


@query("linear_blur", f"""WITH {IMG}, o(i, j) AS (VALUES {_SQ1}), l AS (SELECT x, y, CASE WHEN v / 255e0 <= 0.04045 THEN v / 255e0 / 12.92 ELSE pow((v / 255e0 + 0.055) / 1.055, 2.4) END AS v FROM img),
s AS (SELECT l.x - o.i AS x, l.y - o.j AS y, sum(v) / 9 AS v FROM l, o GROUP BY 1, 2 HAVING count(*) = 9) SELECT x, y, round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END, 7) AS v FROM s""")
def linear_blur(spark, d):
    return _rounded(vision.linear_blur(grids.image(spark, d)), 7)


@query("harris_float", f"""WITH {IMG}, o(i, j) AS (VALUES {_SQ1}), gr AS (SELECT b.x - o.i AS x, b.y - o.j AS y, sum(b.v * o.i * (2 - abs(o.j))) / 12e0 AS gx, sum(b.v * o.j * (2 - abs(o.i))) / 12e0 AS gy FROM img b, o GROUP BY 1, 2 HAVING count(*) = 9),
s AS (SELECT gr.x - o.i AS x, gr.y - o.j AS y, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM gr, o GROUP BY 1, 2 HAVING count(*) = 9) SELECT x, y, round(xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy), 2) AS v FROM s""")
def harris_float(spark, d):
    return _rounded(vision.harris_float(grids.image(spark, d)), 2)


def _layers_sql(rules: list[str]) -> str:
    """One layer on the others, with values and alphas kept whole at each step."""
    shares = {"over": ("255", "(255 - a{n})"), "atop": ("a", "(255 - a{n})"), "xor": ("(255 - a)", "(255 - a{n})"), "in": ("a", "0"), "out": ("(255 - a)", "0")}
    sql = f"WITH {IMG}, l AS (SELECT x, y, (x * 3 + y) % 256 AS a0, (x * 5) % 256 AS a1, (y * 7 + x) % 256 AS a2, (x + y) % 256 AS a3, v FROM img), m AS (SELECT *, least(v, a0) AS v0, least(255 - v, a1) AS v1, least(v * 3 % 256, a2) AS v2, least((v + 50) % 256, a3) AS v3 FROM l), s0 AS (SELECT *, v0 AS t, a0 AS a FROM m)"
    for n, rule in enumerate(rules, 1):
        top, low = (f.format(n=n) for f in shares[rule])
        sql += f", s{n} AS (SELECT * EXCLUDE (t, a), least(255, (v{n} * {top} + 127) // 255 + (t * {low} + 127) // 255) AS t, least(255, (a{n} * {top} + 127) // 255 + (a * {low} + 127) // 255) AS a FROM s{n - 1})"
    return sql + f" SELECT x, y, CAST(t AS BIGINT) AS v, CAST(a AS BIGINT) AS alpha FROM s{len(rules)}"


_RULES = ["over", "xor", "atop"]


@query("composite_layers", _layers_sql(_RULES))
def composite_layers(spark, d):
    assert set(_RULES) <= set(COMPOSITE)
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    alphas = [F.pmod(c, F.lit(256)) for c in (x * 3 + y, x * 5, y * 7 + x, x + y)]
    shades = [v, 255 - v, F.pmod(v * 3, F.lit(256)), F.pmod(v + 50, F.lit(256))]
    value, alpha = vision.composite_layers([(F.least(s, a), a) for s, a in zip(shades, alphas)], _RULES)
    return grids.image(spark, d).df.select("x", "y", value.cast("bigint").alias("v"), alpha.cast("bigint").alias("alpha"))


@query("max_filter_wide", f"WITH {IMG}, o(i, j) AS (VALUES {', '.join(str(o) for o in stencil.square(4) if o[0] ** 2 + o[1] ** 2 <= 18)}) SELECT CAST(b.x - o.i AS INT) AS x, CAST(b.y - o.j AS INT) AS y, max(b.v) AS v FROM img b, o GROUP BY 1, 2 HAVING count(*) = {sum(1 for o in stencil.square(4) if o[0] ** 2 + o[1] ** 2 <= 18)}")
def max_filter_wide(spark, d):
    return stencil.max_disc(grids.image(spark, d), 4).df


def _pass(name: str, t: str, key: str, order: str, back: bool) -> str:
    """One recursive pass over a numbered line."""
    n, step = f"{name}n", "DESC" if back else "ASC"
    return f"""{n} AS (SELECT x, y, v, row_number() OVER (PARTITION BY {key} ORDER BY {order} {step}) AS k FROM {t}),
{name}r AS (SELECT DISTINCT {key} AS key, 0::BIGINT AS k, 0e0 AS v, 0 AS place FROM {n} UNION ALL SELECT r.key, i.k, 0.6e0 * r.v + 0.4e0 * i.v, i.{order} FROM {name}r r JOIN {n} i ON i.{key} = r.key AND i.k = r.k + 1),
{name} AS (SELECT {'key AS x, place AS y' if key == 'x' else 'place AS x, key AS y'}, v FROM {name}r WHERE k > 0)"""


@query("iir_blur", f"WITH RECURSIVE {IMG}, {_pass('a', 'img', 'x', 'y', False)}, {_pass('b', 'a', 'x', 'y', True)}, {_pass('c', 'b', 'y', 'x', False)}, {_pass('e', 'c', 'y', 'x', True)} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(v, 6) AS v FROM e")
def iir_blur(spark, d):
    return _rounded(vision.iir_blur(grids.image(spark, d), 0.4), 6)


def _blur(axis: str, t: str) -> str:
    rest = [a for a in ("gx", "gy", "gz") if a != axis]
    return f"SELECT {', '.join(rest)}, {axis} + o.k AS {axis}, sum(n * o.w) AS n, sum(total * o.w) AS total FROM {t}, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) o(k, w) GROUP BY ALL"


@query("bilateral_trilinear", f"""WITH {IMG}, g AS (SELECT CAST(floor((x + 4e0) / 8) AS INT) AS gx, CAST(floor((y + 4e0) / 8) AS INT) AS gy, CAST(floor((v + 16e0) / 32) AS INT) AS gz, count(*) AS n, sum(v) AS total FROM img GROUP BY 1, 2, 3),
g1 AS ({_blur('gx', 'g')}), g2 AS ({_blur('gy', 'g1')}), g3 AS ({_blur('gz', 'g2')}), b(k) AS (VALUES (0), (1)),
c AS (SELECT x, y, x // 8 + p.k AS gx, y // 8 + q.k AS gy, v // 32 + r.k AS gz, (CASE p.k WHEN 1 THEN x % 8 / 8e0 ELSE 1 - x % 8 / 8e0 END) * (CASE q.k WHEN 1 THEN y % 8 / 8e0 ELSE 1 - y % 8 / 8e0 END) * (CASE r.k WHEN 1 THEN v % 32 / 32e0 ELSE 1 - v % 32 / 32e0 END) AS w FROM img, b p, b q, b r)
SELECT x, y, round(sum(w * total) / sum(w * n), 5) AS v FROM c JOIN g3 USING (gx, gy, gz) WHERE w > 0 GROUP BY x, y""")
def bilateral_trilinear(spark, d):
    return _rounded(vision.bilateral_trilinear(grids.image(spark, d), 8, 32), 5)


_MATRIX = [[300, -30, -14, 10], [-20, 290, -10, -40], [5, -60, 310, 0]]


def _taps_sql(t: str, cols: str, offsets) -> str:
    cells = ", ".join(f"max(CASE WHEN o.i = {i} AND o.j = {j} THEN b.{c} END) AS {c}{k}" for c in cols for k, (i, j) in enumerate(offsets))
    return f"SELECT b.x - o.i AS x, b.y - o.j AS y, {cells} FROM {t} b, (VALUES {', '.join(map(str, offsets))}) o(i, j) GROUP BY 1, 2 HAVING count(*) = {len(offsets)}"


def _camera_sql() -> str:
    cross, sq = [(0, 0), (2, 0), (-2, 0), (0, 2), (0, -2)], stencil.square(1)
    at = {o: f"v{k}" for k, o in enumerate(sq)}
    mean = lambda *o: f"(({' + '.join(at[k] for k in o)}) // {len(o)})"
    own, sides, ends = at[0, 0], mean((-1, 0), (1, 0)), mean((0, -1), (0, 1))
    corners, plus = mean((-1, -1), (1, -1), (-1, 1), (1, 1)), mean((-1, 0), (1, 0), (0, -1), (0, 1))
    ox, oy = "x % 2 = 1", "y % 2 = 1"
    red = f"CASE WHEN {ox} AND NOT {oy} THEN {own} WHEN NOT {ox} AND NOT {oy} THEN {sides} WHEN {ox} AND {oy} THEN {ends} ELSE {corners} END"
    blue = f"CASE WHEN NOT {ox} AND {oy} THEN {own} WHEN {ox} AND {oy} THEN {sides} WHEN NOT {ox} AND NOT {oy} THEN {ends} ELSE {corners} END"
    lin = lambda row: f"greatest(least(floor(({row[0]} * r + {row[1]} * g + {row[2]} * b + {row[3]}) / 256.0), 255), 0)"
    curve = ", ".join(f"CAST(floor(255 * pow({lin(row)} / 255.0, 1 / 1.8::DOUBLE) + 0.5) AS BIGINT) AS {c}" for c, row in zip("rgb", _MATRIX))
    sharp = ", ".join(f"CAST(greatest(least(2 * {c}4 - ({' + '.join(f'{c}{k}' for k in range(9))}) // 9, 255), 0) AS BIGINT) AS {c}" for c in "rgb")
    return f"""WITH {IMG}, h AS (SELECT x, y, least(v0, greatest(v1, v2, v3, v4)) AS v FROM ({_taps_sql('img', 'v', cross)})), t AS ({_taps_sql('h', 'v', sq)}),
c AS (SELECT x, y, {red} AS r, CASE WHEN ({ox}) = ({oy}) THEN {own} ELSE {plus} END AS g, {blue} AS b FROM t), m AS (SELECT x, y, {curve} FROM c), n AS ({_taps_sql('m', 'rgb', sq)}) SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {sharp} FROM n"""


@query("camera_pipe", _camera_sql())
def camera_pipe(spark, d):
    return vision.camera_pipe(grids.image(spark, d), _MATRIX).df


@query("resize_2d", f"""WITH {IMG}, h AS (SELECT max(y) + 1 AS h FROM img), a AS (SELECT s.y, o.range AS x, sum(s.v * w) / sum(w) AS v FROM (SELECT s.y, o.range, s.v, greatest(1 - abs((s.x - ((o.range + 0.5e0) / 1.5e0 - 0.5e0))), 0) AS w FROM img s CROSS JOIN range(150) o) s(y, range, v, w), (SELECT 1) o1, LATERAL (SELECT s.range) o WHERE w > 0 GROUP BY 1, 2),
b AS (SELECT a.x, p.p AS y, a.v, greatest(1 - abs((a.y - ((p.p + 0.5e0) / 0.5e0 - 0.5e0)) * 0.5e0), 0) AS w FROM a, (SELECT unnest(range(h // 2)) AS p FROM h) p)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(sum(v * w) / sum(w), 5) AS v FROM b WHERE w > 0 GROUP BY 1, 2""")
def resize_2d(spark, d):
    """Wider by half, half as high."""
    a = grids.image(spark, d, region=True)
    wide = resample.resize_1d(a, "x", 1.5, 150, "linear")
    return _rounded(resample.resize_1d(wide, "y", 0.5, a.region[1].extent // 2, "linear"), 5)
