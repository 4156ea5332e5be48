"""Semantics against plain Python: types, division, boundaries, programs, errors."""

import math
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.functions.types import F32, F64, I8, I16, I32, I64, U8, U16, U32, Float, Int, UInt, common_type
from tessera.operators import boundary, reduce, resample, stencil
from tessera.operators.table import ArrayTable, domain, generate, make_scalar
from tessera.plans.func import Func, Image, Pipeline, RDom, Var
from tessera.plans.region import Range, box, interval
from tessera.sources import codecs, grids
from tessera.streaming import events

x, y = Var("x"), Var("y")


def values(spark, rows, schema, e):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(e.column()).collect()]


def test_common_types():
    assert common_type(I8, U16) == I16 and common_type(I32, U32) == I32 and common_type(I64, F32) == F32
    assert common_type(U8, U16) == U16 and common_type(F32, F64) == F64 and common_type(Int(64), UInt(8)) == I64
    assert I8.min == -128 and U16.max == 65535 and Float(32).min == float("-inf")
    with pytest.raises(TypeError):
        E.col("a", U8) + 300
    with pytest.raises(TypeError):
        bool(E.col("a", U8) == 1)


def test_euclidean_division(spark):
    rows = [(a, b) for a in range(-9, 10) for b in range(-4, 5)]
    a, b = E.col("a", I32), E.col("b", I32)
    for (p, q), d, m in zip(rows, values(spark, rows, "a int, b int", a / b), values(spark, rows, "a int, b int", a % b)):
        if q == 0:
            assert (d, m) == (0, 0)
        else:
            assert d * q + m == p and 0 <= m < abs(q)


def test_wrapping_at_limits(spark):
    cases = {I8: [-128, 127, 5], U8: [0, 255, 7], I16: [-32768, 32767], U32: [0, 2**32 - 1, 12345], I32: [-(2**31), 2**31 - 1], I64: [-(2**63), 2**63 - 1]}
    for t, vals in cases.items():
        rows = [(p, q) for p in vals for q in vals]
        a, b = E.col("a", t), E.col("b", t)
        for e, f in ((a + b, lambda p, q: p + q), (a - b, lambda p, q: p - q), (a * b, lambda p, q: p * q)):
            got = values(spark, rows, f"a {t.spark}, b {t.spark}", e)
            want = [(f(p, q) - t.min) % (1 << t.bits) + t.min for p, q in rows]
            assert [int(g) for g in got] == want, t


def test_logarithms_and_roots(spark):
    v = E.col("v", F64)
    got = values(spark, [(0.0,), (-1.0,), (1.0,)], "v double", E.log(v))
    assert got[0] == float("-inf") and np.isnan(got[1]) and got[2] == 0
    erf = values(spark, [(-1.0,), (0.0,), (0.5,)], "v double", E.erf(v))
    assert np.allclose(erf, [-0.8427008, 0, 0.5204999], atol=1e-6)


def test_rng_step(spark):
    c0, c1, c2 = E.RNG_COEFFICIENTS
    for v in (0, 1, 4000000000, 2**32 - 1):
        got = spark.range(1).select(E.rng32(F.lit(v).cast("bigint"))).first()[0]
        assert got == ((c2 * v + c1) * v + c0) % 2**32
    assert spark.range(1).select(E.rng32(F.lit(4000000000).cast("bigint"))).first()[0] == 1954798397


def test_lerp_is_exact(spark):
    rows = [(z, w) for z in range(0, 256, 5) for w in range(0, 256, 3)]
    got = values(spark, rows, "z smallint, w smallint", E.lerp(E.col("z", U8), E.const(200, U8), E.col("w", U8)))
    assert got == [(z * (255 - w) + 200 * w + 127) // 255 for z, w in rows]
    with pytest.raises(ValueError):
        E.lerp(E.col("z", U8), E.const(200, U8), 1.5)


@settings(max_examples=40, deadline=None)
@given(st.integers(-20, 20), st.integers(1, 9), st.integers(-9, 9), st.integers(1, 7))
def test_interval_covers(lo, extent, shift, div):
    env = {"x": Range(lo, extent)}
    points = range(lo, lo + extent)
    for e, f in (((x + shift) / div, lambda p: (p + shift) // div), (x * shift - 3, lambda p: p * shift - 3), ((x + shift) % div, lambda p: (p + shift) % div), (E.clamp(x, -3, 4), lambda p: max(min(p, 4), -3))):
        a, b = interval(e, env)
        assert all(a <= f(p) <= b for p in points)


BOUNDARIES = {
    boundary.repeat_edge: lambda p, lo, w: min(max(p, lo), lo + w - 1),
    boundary.repeat_image: lambda p, lo, w: lo + (p - lo) % w,
    boundary.mirror_image: lambda p, lo, w: lo + (m if (m := (p - lo) % (2 * w)) < w else 2 * w - 1 - m),
    boundary.mirror_interior: lambda p, lo, w: lo if w == 1 else lo + (w - 1) - abs((p - lo) % (2 * (w - 1)) - (w - 1)),
}


@pytest.mark.parametrize("f", BOUNDARIES, ids=lambda f: f.__name__)
@pytest.mark.parametrize("lo,w", [(-3, 1), (0, 2), (5, 7)])
def test_boundaries(spark, f, lo, w):
    a = generate(spark, ("x",), [(lo, w)], F.col("x") * 10, I64)
    got = {r.x: r.v for r in f(a, [(-30, 70)]).df.collect()}
    assert got == {p: 10 * BOUNDARIES[f](p, lo, w) for p in range(-30, 40)}


def test_domain(spark):
    rows = [tuple(r) for r in domain(spark, ["x", "y", "z"], box((-1, 3), 2, (5, 4))).collect()]
    assert sorted(rows) == sorted((a, b, c) for a in range(-1, 2) for b in range(2) for c in range(5, 9))
    assert domain(spark, ["x"], box(0)).count() == 0


def img(spark, w=12, h=9, seed=3):
    a = np.random.default_rng(seed).integers(0, 256, (h, w)).astype("int64")
    return a, codecs.from_numpy(spark, a, ("x", "y"))


def test_shapes(spark):
    a, t = img(spark)
    assert (codecs.to_numpy(t) == a).all() and t.check_dense() and t.width == 12 and t.bottom == 8 and t.number_of_elements() == 108
    assert (codecs.to_numpy(t.transpose()) == a.T).all()
    assert (codecs.to_numpy(t.crop("x", 2, 5).set_min(0, 0)) == a[:, 2:7]).all()
    assert (codecs.to_numpy(t.concat(t, "x")) == np.hstack((a, a))).all()
    assert t.at(3, 4) == a[4, 3] and t.contains(11, 8) and not t.contains(12, 0)
    assert t.fill(3).all_equal(3) and not t.all_equal(3)
    assert (codecs.to_numpy(t.deinterleave("x").slice("c", 1)) == a[:, 1::2]).all()
    assert make_scalar(spark, 4.0).at() == 4.0
    lines = {r.y: list(r.vals) for r in t.to_scanlines("x").collect()}
    assert all(lines[k] == a[k].tolist() for k in range(9))


def test_stencils(spark):
    a, t = img(spark)
    pad = np.lib.stride_tricks.sliding_window_view(a, (3, 3))
    for f, g in ((stencil.dilate3, np.max), (stencil.erode3, np.min), (stencil.median3, np.median)):
        got = f(t)
        assert got.region == (Range(1, 10), Range(1, 7))
        assert (codecs.to_numpy(got) == g(pad, axis=(2, 3))).all()


def test_pyramids_and_wavelets(spark):
    a, t = img(spark, 16, 8)
    assert (codecs.to_numpy(resample.downsample(t)) == a.reshape(4, 2, 8, 2).sum(axis=(1, 3)) // 4).all()
    w = t.map(w=F.when(F.col("x") % 3 == 0, 0.0).otherwise(1.0))
    filled = resample.pull_push(w._with(w.df.withColumn("v", F.lit(7.0))), 4).df
    assert filled.agg(F.min("v"), F.max("v")).first() == (7.0, 7.0)
    assert [p.width for p in resample.pyramid(t, 3)] == [16, 8, 4]
    for kernel in resample.KERNELS:
        flat = resample.resize_1d(t.fill(5), "x", 1.7, 27, kernel).df
        assert flat.where(F.abs(F.col("v") - 5) > 1e-9).isEmpty() and flat.count() == 27 * 8


def test_saturating_fold(spark):
    rows = [(0, i, v) for i, v in enumerate([100, 100, -50, 127, -128, -128, 5])]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    acc = 0
    for _, _, v in rows:
        acc = max(-128, min(127, acc + v))
    assert df.groupBy("g").agg(reduce.saturating_fold(F.col("v"), F.col("i"), I8).alias("v")).first().v == acc


def test_func_program(spark):
    a, t = img(spark)
    im, f, g = Image(t, 2, I64), Func("f"), Func("g")
    f[x, y] = im[E.clamp(x, 0, 11), E.clamp(y, 0, 8)]
    g[x, y] = f[x - 1, y] + f[x + 1, y] * 2
    pad = np.pad(a, ((0, 0), (1, 1)), "edge")
    for root in (False, True):
        f.root = root
        got = g.realize([(0, 12), (0, 9)], spark)
        assert (codecs.to_numpy(got) == pad[:, :-2] + 2 * pad[:, 2:]).all()
    assert g.infer_input_regions([(2, 3), (0, 2)])[im] == box((1, 5), 2)
    f2 = Func("plain")
    f2[x, y] = im[x + 5, y]
    with pytest.raises(IndexError):
        f2.realize([12, 9], spark)


def test_func_updates(spark):
    h, r = Func("h"), RDom([(0, 30)])
    h[x] = 1
    h[r.x % 4] += r.x
    h[x] = h[x] * 2
    want = [2 * (1 + sum(v for v in range(30) if v % 4 == k)) for k in range(4)]
    assert codecs.to_numpy(h.realize([4], spark)).tolist() == want
    fib, q = Func("fib"), RDom([(2, 18)])
    fib[x] = 1
    fib[q.x] = fib[q.x - 1] + fib[q.x - 2]
    assert codecs.to_numpy(fib.realize([20], spark)).tolist()[-1] == 6765
    t, s = Func("t"), RDom([(0, 6)])
    t[x] = (0, 1)
    t[s.x / 2] = (t[s.x / 2][0] + s.x, E.max_(t[s.x / 2][1], s.x))
    got = {row[0]: (row[1], row[2]) for row in t.realize([4], spark).df.collect()}
    assert got == {0: (1, 1), 1: (5, 3), 2: (9, 5), 3: (0, 1)}
    a, b = Func("a"), Func("b")
    a[x] = x
    b[x] = a[x] + 1
    assert [codecs.to_numpy(o).tolist() for o in Pipeline(a, b).realize([3], spark)] == [[0, 1, 2], [1, 2, 3]]


def test_func_errors(spark):
    f, r = Func("f"), RDom([(0, 3)])
    with pytest.raises(NameError):
        f[x] = y + 1
    f[x] = 0
    with pytest.raises(TypeError):
        f[x, y] = 1
    with pytest.raises(TypeError):
        f[x] = (1, 2)
    with pytest.raises(TypeError):
        f[x] = E.const(1.5)
    f[r.x] = 1
    with pytest.raises(RuntimeError):
        r.where(r.x < 2)
    f.realize([3], spark)
    with pytest.raises(RuntimeError):
        f[r.x] = 2
    with pytest.raises(TypeError):
        Image(dims=2).set(make_scalar(spark, 1.0))
    g = Func("g")
    g[x] = x
    g.add_requirement(x < 2, "too far")
    with pytest.raises(Exception, match="too far"):
        g.realize([3], spark).df.collect()


@pytest.mark.parametrize("name,dtype,shape", [("a.npy", "float32", (5, 4)), ("a.npy", "uint16", (3, 4, 2)), ("a.pgm", "uint8", (6, 3)), ("a.ppm", "uint16", (4, 5, 3)), ("a.tmp", "float64", (3, 2, 2))])
def test_codecs(spark, tmp_path, name, dtype, shape):
    a = (np.random.default_rng(1).random(shape) * 200).astype(dtype)
    data = codecs.encode(name, a)
    back = codecs.decode(name, data)
    assert (back.reshape(shape) == a).all()
    (tmp_path / name).write_bytes(data)
    got = codecs.load(spark, str(tmp_path / name)).collect()
    assert len(got) == a.size and abs(sum(r.v for r in got) - a.astype(float).sum()) < 1e-6


def test_convert_image(spark):
    t = generate(spark, ("x",), [256], F.col("x"), U8)
    up = codecs.convert_image(t, U16)
    assert {r.x: r.v for r in up.df.collect()} == {i: i * 257 for i in range(256)}
    back = codecs.convert_image(codecs.convert_image(t, F32), U8)
    assert {r.x: r.v for r in back.df.collect()} == {i: i for i in range(256)}


def test_synthetic(spark):
    r = grids.synthetic(spark, "random:7", ("x", "y"), [20, 20]).df
    lo, hi, mean = r.agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert 0 <= lo < hi < 1 and 0.4 < mean < 0.6
    assert grids.synthetic(spark, "identity:", ("x", "y"), [4, 4]).df.agg(F.sum("v")).first()[0] == 4


def test_streams_equal_tables(spark):
    path = "/root/testdata/sf0.001"
    table = {tuple(r) for r in events.windowed_histogram(grids.read(spark, path, "events")).collect()}
    stream = events.event_stream(spark, f"{path}/events.parquet*")
    got = {tuple(r) for r in events.run_to_memory(events.windowed_histogram(stream), "hist_stream").collect()}
    assert got == table


def test_nl_means_keeps_flat_images(spark):
    t = generate(spark, ("x", "y"), [8, 8], F.lit(9.0), F64)
    out = stencil.nl_means(t, 1, 1, 1.0).df
    assert out.count() and out.where(F.abs(F.col("v") - 9) > 1e-9).isEmpty()


def test_nl_means_query_takes_the_whole_image(spark, tmp_path):
    from tessera import queries

    h, v = 26, lambda x, y: (x * 37 + y * 91 + x * y) % 256
    rows = [(y * 100 + x, v(x, y) * 2.0) for y in range(h) for x in range(100)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.x, r.y): r.v for r in queries.queries()["nl_means"](spark, str(tmp_path)).collect()}
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for y in range(2, h - 2):
        for x in (2, 50, 97):
            ds = [sum((v(x + p, y + q) - v(x + p + i, y + q + j)) ** 2 for p, q in near) for i, j in near]
            w = [math.exp(-d / (30.0**2 * 9)) for d in ds]
            want = sum(a * v(x + i, y + j) for a, (i, j) in zip(w, near)) / sum(w)
            assert abs(got[x, y] - want) < 1e-5


def test_moving_blocks(spark):
    a = generate(spark, ("k",), [300], F.pmod(F.col("k") * 7919, F.lit(101)), I64)
    got = {r.k: r.v for r in reduce.moving(a, "k", 5, 2, F.max, block=16).df.collect()}
    v = [k * 7919 % 101 for k in range(300)]
    assert got == {k: max(v[max(0, k - 5) : k + 3]) for k in range(300)}


def test_array_table_errors(spark):
    with pytest.raises(ValueError):
        ArrayTable(spark.range(3), ("x",))


def test_the_entry_is_imported_without_a_session():
    """In a process of its own: no query may need Spark before it runs."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
