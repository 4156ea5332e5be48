"""The function front end and what is under it: parameters, directives, exchanges, folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.functions.types import F32, F64, I8, I16, I32, I64, U8, U32, U64
from tessera.operators import halo, reduce
from tessera.operators.table import ArrayTable, generate
from tessera.plans import generator
from tessera.plans.extern import Extern, call_extern, extern
from tessera.plans.func import Func, Image, Param, RDom, Var, _, evaluate
from tessera.plans.generator import Generator, Input, Output, Parameter

x, y = Var("x"), Var("y")


def values(table: ArrayTable) -> dict:
    return {tuple(r[d] for d in table.dims): r[table.values[0]] for r in table.df.collect()}


def test_parameters_check_their_range(spark):
    p, f = Param(I32, 3, min=0, max=9), Func()
    f[x] = x * p
    assert values(f.realize([4], spark)) == {(i,): 3 * i for i in range(4)}
    p.set(5)
    assert values(f.realize([4], spark)) == {(i,): 5 * i for i in range(4)}
    for wrong in (-1, 10):
        with pytest.raises(ValueError):
            p.set(wrong)
    with pytest.raises(ValueError):
        Param(U8).column()
    with pytest.raises(ValueError):
        Param(U8, 256)


def test_expressions_alone(spark):
    assert evaluate(E.const(6) * 7, spark) == 42
    f = Func(x * 10 + y)
    assert f.args == ["x", "y"] and values(f.realize([2, 2], spark))[1, 1] == 11
    g = Func()
    g[_] = f[_] + 1
    assert values(g.realize([2, 2], spark))[1, 0] == 11
    with pytest.raises(NameError):
        h = Func()
        h[x] = x + h[x]


def test_implied_definitions(spark):
    f, g, r = Func(), Func(), RDom([(0, 5)])
    f[x] += r.x * x
    g[x] *= r.x + 1
    assert values(f.realize([3], spark)) == {(0,): 0, (1,): 10, (2,): 20}
    assert values(g.realize([2], spark)) == {(0,): 120, (1,): 120}


def test_cases_and_bounds(spark):
    f, p = Func(), Param(I32, 1)
    f[x] = x
    f.specialize(p == 1)
    f.specialize_fail("no such case")
    assert values(f.realize([2], spark)) == {(0,): 0, (1,): 1}
    p.set(2)
    with pytest.raises(PySparkException, match="no such case"):
        f.realize([2], spark).df.collect()
    g = Func()
    g[x, y] = x + y
    g.bound(x, 0, 4).bound_extent(y, 2)
    g.realize([4, (7, 2)], spark)
    for wrong in ([5, 2], [(1, 4), 2], [4, 3]):
        with pytest.raises(IndexError):
            g.realize(wrong, spark)


def test_broken_promises(spark):
    f, g = Func(), Func()
    f[x] = E.promise_clamped(x, 0, 2)
    g[x] = E.select(x < 2, x, E.unreachable())
    assert len(values(f.realize([3], spark))) == len(values(g.realize([2], spark))) + 1
    for h, n in ((f, 4), (g, 3)):
        with pytest.raises(PySparkException):
            h.realize([n], spark).df.collect()


def test_lossless_casts():
    a, u = E.col("a", I32), E.col("u", U8)
    assert E.lossless_cast(I8, u) is None and E.lossless_cast(I8, a) is None and E.lossless_cast(F32, a) is None and E.lossless_cast(I32, E.col("f", F64)) is None
    assert E.lossless_cast(I16, u).type == I16 and E.lossless_cast(U8, a & 255).type == U8 and E.lossless_cast(I8, E.i32(E.col("b", I8))).type == I8
    assert E.lossless_cast(F64, a).type == F64 and E.lossless_cast(I8, E.min_(u, 100)).type == I8


@pytest.mark.parametrize("op", ["add", "max", "mul"])
def test_rfactor(spark, op):
    img = Image(generate(spark, ("x", "y"), [12, 5], (F.col("x") * 7 + F.col("y") * 3) % 11 + 1, I32))
    f, u, r = Func(), Var("u"), RDom([(0, 4), (0, 3)])
    e = img[r.x + r.y * 4, y]
    r.where(r.x != 2)
    f[y] = {"add": 0, "max": -99, "mul": 1}[op]
    f[y] = {"add": lambda a: a + e, "max": lambda a: E.max_(a, e), "mul": lambda a: a * e}[op](f[y])
    part = f.rfactor({r.y: u})
    assert part.args == [f.args[0], "u"] and "aggregate" in f.print_loop_nest()
    got = values(f.realize([5], spark))
    for j in range(5):
        cells = [(i * 7 + j * 3) % 11 + 1 for i in range(12) if i % 4 != 2]
        want = {"add": sum(cells), "max": max(cells), "mul": int(np.prod(np.array(cells, dtype=np.int32), dtype=np.int32))}[op]
        assert got[j,] == want


def test_change_type_keeps_sums(spark):
    f, r = Func(), RDom([(0, 100)])
    f[x] = E.const(0, U8)
    f[x] += E.u8(r.x)
    assert values(f.change_type(I64).realize([2], spark)) == {(0,): 4950 % 256, (1,): 4950 % 256}


def test_memoized_and_dumped(spark, tmp_path):
    f = Func()
    f[x] = x * x
    f.memoize()
    a, b = f.realize([9], spark), f.realize([9], spark)
    assert a is b and f.realize([3], spark) is not a
    out = f.debug_to_file([4], spark, str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump")).count() == 4 == out.df.count()


class Sum3(Generator):
    radius = Parameter(1, min=0, max=5)
    image = Input(1)
    result = Output(1, I32)

    def generate(self):
        e = E.const(0)
        for k in range(-self.radius, self.radius + 1):
            e = e + self.image[x + k]
        self.result[x] = e

    def schedule(self):
        self.result.compute_root().vectorize(x, 4)


def test_generators(spark):
    table = generate(spark, ("x",), [(-2, 10)], F.col("x"))
    assert values(Sum3()([5], spark, table)) == {(i,): 3 * i for i in range(5)}
    assert values(generator.create("Sum3", radius=2)([5], spark, table)) == {(i,): 5 * i for i in range(5)}
    assert "Sum3" in generator.names()
    with pytest.raises(ValueError):
        Sum3(radius=6)
    with pytest.raises(TypeError):
        Sum3(size=1)
    with pytest.raises(TypeError):
        Sum3()([5], spark)


def test_extern_stages(spark):
    table = generate(spark, ("x", "y"), [6, 3], F.col("x") * 2 + F.col("y"))
    shift = Extern(lambda f, by: f.assign(x=(f["x"] - by).astype("int32")), ("x", "y"), (I32,), groups=("y",), needs=lambda out: [(out[0][0] + 1, out[0][1]), out[1]])
    assert [r.min for r in shift.input_region([5, 3])] == [1, 0]
    got = values(shift.realize([5, 3], spark, table, 1))
    assert got == {(i, j): (i + 1) * 2 + j for i in range(5) for j in range(3)}
    g = Func()
    g[x, y] = shift.image([5, 3], spark, table, 1)[x, y] + 1
    assert values(g.realize([5, 3], spark))[0, 0] == 3
    extern("plus_one", I32, lambda c: c + 1, I32)
    f = Func()
    f[x] = call_extern("plus_one", x)
    assert values(f.realize([3], spark)) == {(i,): i + 1 for i in range(3)}
    with pytest.raises(TypeError):
        call_extern("plus_one", x, y)


def test_lanes_that_do_not_match():
    f = Func()
    f[x] = x
    with pytest.raises(TypeError):
        f[E.scatter(0, 1)] = E.gather(f[1], f[0], f[2])


@pytest.mark.parametrize("edge", [3, 64])
def test_reads_by_tiles(spark, edge):
    """Cells with holes, places below zero, several arrays, points without cells."""
    rng = np.random.default_rng(1)
    cells = {(int(a), int(b)): int(v) for a, b, v in zip(rng.integers(-9, 9, 150), rng.integers(-9, 9, 150), rng.integers(0, 99, 150))}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, v long")
    points = spark.createDataFrame([(a, b, a * b) for a in range(-12, 12) for b in range(-12, 12)], "x int, y int, own int")
    taps = [((0, 0), "c"), ((2, -1), "r"), ((-4, 4), "f")]
    other = df.withColumn("w", F.col("v").cast("string"))
    got = halo.gather(points, ["x", "y"], [(df, "v", taps), (other, "w", [((1, 1), "s")])], edge).collect()
    assert len(got) == 24 * 24
    for r in got:
        assert r.own == r.x * r.y and r.s == (str(cells[r.x + 1, r.y + 1]) if (r.x + 1, r.y + 1) in cells else None)
        for (i, j), name in taps:
            assert r[name] == cells.get((r.x + i, r.y + j))


def test_stencils_plan_one_exchange(spark):
    img = Image(generate(spark, ("x", "y"), [30, 20], F.col("x") + F.col("y"), I32))
    f, e = Func(), E.const(0)
    for i in range(-2, 3):
        for j in range(-2, 3):
            e = e + img[x + i, y + j]
    f[x, y] = e
    df = f.realize([(2, 26), (2, 16)], spark).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert values(ArrayTable(df, ("x", "y"), ("v",), (I32,)))[5, 7] == 25 * 12


@pytest.mark.parametrize("bits", [1, 12])
def test_products_and_folds(spark, monkeypatch, bits):
    monkeypatch.setattr(reduce, "_FOLD_BITS", bits)
    df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 12345 + 7).alias("v"))
    got = {r.k: r.v for r in reduce.product_by(df, ["k"], F.col("v")).collect()}
    for k in range(3):
        want = 1
        for i in range(k, 200, 3):
            want = want * (i * 12345 + 7) % (1 << 64)
        assert got[k] == (want + (1 << 63)) % (1 << 64) - (1 << 63)
    big = spark.createDataFrame([(0, 3**20), (0, 3**20 + 2)], "k int, v long")
    assert reduce.product_by(big, ["k"], F.col("v")).first().v == -6289078607679054013
    with pytest.raises(PySparkException, match="product_by"):
        big.agg(reduce.product(F.col("v"))).collect()


def test_linear_recurrences(spark):
    rng = np.random.default_rng(5)
    v, f = rng.normal(size=500), rng.uniform(-1, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"k": np.repeat([0, 1], 250), "t": np.tile(np.arange(250), 2), "v": v, "f": f}))
    for reverse in (False, True):
        got = {(r.k, r.t): r.v for r in reduce.affine_scan(df, ["k"], "t", F.col("v"), F.col("f"), block=16, reverse=reverse).collect()}
        for k in (0, 1):
            acc = 0.0
            for t in reversed(range(250)) if reverse else range(250):
                acc = f[k * 250 + t] * acc + v[k * 250 + t]
                assert abs(got[k, t] - acc) < 1e-9
    folded = reduce.fold(df, ["k"], "t", F.col("v"), F.lit(0.0), lambda a, b: a * 0.5 + b, block=7).collect()
    acc = {}
    for r in sorted(folded, key=lambda r: (r.k, r.t)):
        acc[r.k] = acc.get(r.k, 0.0) * 0.5 + v[r.k * 250 + r.t]
        assert abs(acc[r.k] - r.v) < 1e-9
    assert len(folded) == 500


def test_long_scans_scan_their_blocks_by_blocks(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 17).alias("v"))
    got = {r.k: r.s for r in reduce.long_scan(df, "k", F.col("v"), 8, "s", most_blocks=20).collect()}
    assert [got[i] for i in range(5000)] == np.cumsum(np.arange(5000) % 17).tolist()


def _sums_in_order(start, add, t, lags, fast, slow):
    """What a loop over both ranges stores; null (None) where anything it adds is."""
    f = dict(start)
    for b in range(*slow):
        for a in range(*fast):
            parts = [add(a, b, f[a, b]), *[f[a + i, b + j] if s > 0 or f[a + i, b + j] is None else -f[a + i, b + j] for (i, j), s in lags.items()]]
            f[a, b] = None if None in parts else (sum(parts) - t.min) % (1 << t.bits) + t.min
    return f


_BOTH = {(-1, 0): 1, (0, -1): 1, (-1, -1): -1}


@pytest.mark.parametrize("block", [3, 1 << 17])
@pytest.mark.parametrize("t, lags", [(I64, _BOTH), (U64, _BOTH), (U32, _BOTH), (I8, _BOTH), (I32, {(-1, 0): 1}), (I64, {(0, -1): 1})])
def test_sums_over_both_coordinates_are_scans(spark, monkeypatch, t, lags, block):
    """Whole numbers of any width wrap, ranges begin inside, and a gap in the input spreads."""
    monkeypatch.setattr(reduce, "_SCAN_BLOCK", block)
    big = t.max // 3
    table = generate(spark, ("x", "y"), [9, 8], F.col("x") * 5 + F.col("y") * F.col("y"), I32)
    img = Image(ArrayTable(table.df.where("not (x = 6 and y = 4)"), ("x", "y"), ("v",), (I32,), table.region))
    f, r = Func(), RDom([(2, 6), (1, 5)])
    f[x, y] = E.cast(t, x * 7 - y * y) + E.const(big, t)
    e = f[r.x, r.y] - E.cast(t, img[r.x, r.y])
    for (i, j), s in lags.items():
        e = e + f[r.x + i, r.y + j] if s > 0 else e - f[r.x + i, r.y + j]
    f[r.x, r.y] = e
    got = f.realize([9, 8], spark)
    wrapped = lambda v: (v - t.min) % (1 << t.bits) + t.min
    start = {(a, b): wrapped(a * 7 - b * b + big) for a in range(-1, 9) for b in range(-1, 8)}
    want = _sums_in_order(start, lambda a, b, old: None if (a, b) == (6, 4) else old - (a * 5 + b * b), t, lags, (2, 8), (1, 6))
    assert values(got) == {k: v for k, v in want.items() if min(k) >= 0}
    assert "collect_list" not in got.df._jdf.queryExecution().executedPlan().toString()


def test_sums_over_both_coordinates_of_each_layer(spark):
    """The fast variable second, a pure one beside, nothing of the place's own, a wider sum cast back."""
    c = Var("c")
    f, r = Func(), RDom([(0, 5), (0, 4)])
    f[y, c, x] = E.cast(I8, x * 3 + y * 20 + c)
    f[r.y, c, r.x] = E.cast(I8, E.cast(I32, f[r.y, c, r.x - 1]) + f[r.y - 1, c, r.x] - f[r.y - 1, c, r.x - 1] + r.x * c)
    got = f.realize([4, 3, 5], spark)
    for k in range(3):
        start = {(a, b): (a * 3 + b * 20 + k + 128) % 256 - 128 for a in range(-1, 5) for b in range(-1, 4)}
        want = _sums_in_order(start, lambda a, b, old: a * k, I8, _BOTH, (0, 5), (0, 4))
        assert {(a, b): v for (b, at, a), v in values(got).items() if at == k} == {p: v for p, v in want.items() if min(p) >= 0}
    assert "collect_list" not in got.df._jdf.queryExecution().executedPlan().toString()


def test_other_recurrences_over_both_coordinates_stay_folds(spark):
    """Twice a value, a value ahead, a greatest: not running sums."""
    forms = [lambda f, r: f[r.x - 1, r.y] * 2 + f[r.x, r.y - 1], lambda f, r: f[r.x - 1, r.y] + f[r.x + 1, r.y], lambda f, r: f[r.x - 1, r.y] + f[r.x, r.y - 1] + 1, lambda f, r: E.max_(f[r.x - 1, r.y] + 1, f[r.x, r.y - 1])]
    steps = [lambda f, a, b: f[a - 1, b] * 2 + f[a, b - 1], lambda f, a, b: f[a - 1, b] + f[a + 1, b], lambda f, a, b: f[a - 1, b] + f[a, b - 1] + 1, lambda f, a, b: max(f[a - 1, b] + 1, f[a, b - 1])]
    for form, step in zip(forms, steps):
        f, r = Func(), RDom([(0, 4), (0, 3)])
        f[x, y] = E.i64(x + y * 2)
        f[r.x, r.y] = form(f, r)
        want = {(a, b): a + b * 2 for a in range(-1, 5) for b in range(-1, 3)}
        for b in range(3):
            for a in range(4):
                want[a, b] = step(want, a, b)
        assert values(f.realize([4, 3], spark)) == {(a, b): want[a, b] for a in range(4) for b in range(3)}


def test_in_place_steps_with_predicates(spark):
    f, r = Func(), RDom([(0, 10)])
    r.where(r.x % 3 != 1)
    f[x] = 1
    f[x] = f[x] * 2 - r.x
    want = 1
    for i in range(10):
        if i % 3 != 1:
            want = want * 2 - i
    assert set(values(f.realize([3], spark)).values()) == {want}


def test_custom_passes(spark):
    """A rewrite of the tree: every 7 becomes 8."""
    f = Func()
    f[x] = x * 7 + 1
    f.add_custom_lowering_pass(lambda e: e.rebuild(lambda n: E.const(8, n.type) if n.value == 7 else None))
    assert values(f.realize([3], spark)) == {(i,): 8 * i + 1 for i in range(3)}
    g = Func()
    g[x] = x
    g.add_custom_lowering_pass(lambda e: E.cast(F64, e))
    with pytest.raises(TypeError):
        g.realize([3], spark)
