"""Iteration to a state within a row, and recurrent layers as ordered folds of a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gates of each kind of layer, in the order of their rows in the weights (fixed).
GATES = {"rnn": ("h",), "gru": ("z", "r", "h"), "lstm": ("i", "o", "f", "c")}


def iterate(df: DataFrame, init: dict[str, Column], steps: int, step: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """``df`` and the columns of ``init`` after ``steps`` steps, each row on its own: no
    shuffle, and a plan whose size does not depend on the number of steps.  A state keeps
    the types that it starts with."""
    types = {k: df.select(c.alias(k)).schema[k].dataType for k, c in init.items()}

    def one(state: Column, _: Column) -> Column:
        new = step({k: state[k] for k in init})
        return F.struct(*[new.get(k, state[k]).cast(t).alias(k) for k, t in types.items()])

    start = F.struct(*[c.alias(k) for k, c in init.items()])
    end = F.aggregate(F.array_repeat(F.lit(0), steps), start, one)
    return df.withColumn("_s", end).select(*df.columns, *[F.col("_s")[k].alias(k) for k in init])


def _matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _sigmoid(a: Column) -> Column:
    return F.transform(a, lambda v: 1 / (1 + F.exp(-v)))


def _tanh(a: Column) -> Column:
    return F.transform(a, F.tanh)


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def recurrent(df: DataFrame, keys: list[str], order: str, kind: str, w: Sequence[Sequence[float]], r: Sequence[Sequence[float]], b: Sequence[float], x: str = "x", out: str = "h") -> DataFrame:
    """keys, order, ``out``: the hidden vector of a recurrent layer after each step of the
    series in ``x`` (array<double>), from a zero state.

    ``w``, ``r`` and ``b`` have a row for each unit of each gate, gate by gate as in
    ``GATES``, for the input, the hidden vector and the bias.  Sigmoid gates, tanh
    elsewhere; a GRU's reset comes before its product.  A series is folded by one task
    and has to fit in its memory, as in ``reduce.fold``.
    """
    gates = GATES[kind]
    units = len(w) // len(gates)
    zero = F.array_repeat(F.lit(0.0), units)
    part = {g: slice(i * units, (i + 1) * units) for i, g in enumerate(gates)}

    def gate(g: str, value: Column, hidden: Column) -> Column:
        own = F.transform(_matrix(w[part[g]]), lambda row: _dot(row, value))
        back = F.transform(_matrix(r[part[g]]), lambda row: _dot(row, hidden))
        bias = F.array(*[F.lit(float(v)) for v in b[part[g]]])
        return _zip(_zip(own, back, lambda p, q: p + q), bias, lambda p, q: p + q)

    def one(state: Column, item: Column) -> Column:
        h, c, v = state["h"], state["c"], item["v"]
        if kind == "rnn":
            h = _tanh(gate("h", v, h))
        elif kind == "gru":
            z, reset = _sigmoid(gate("z", v, h)), _sigmoid(gate("r", v, h))
            new = _tanh(gate("h", v, _zip(reset, h, lambda p, q: p * q)))
            h = _zip(_zip(z, new, lambda p, q: (1 - p) * q), _zip(z, h, lambda p, q: p * q), lambda p, q: p + q)
        else:
            kept = _zip(_sigmoid(gate("f", v, h)), c, lambda p, q: p * q)
            added = _zip(_sigmoid(gate("i", v, h)), _tanh(gate("c", v, h)), lambda p, q: p * q)
            c = _zip(kept, added, lambda p, q: p + q)
            h = _zip(_sigmoid(gate("o", v, h)), _tanh(c), lambda p, q: p * q)
        row = F.struct(item["o"].alias(order), h.alias(out))
        return F.struct(h.alias("h"), c.alias("c"), F.concat(state["all"], F.array(row)).alias("all"))

    kind_of = df.schema[order].dataType.simpleString()
    start = F.struct(zero.alias("h"), zero.alias("c"), F.expr(f"cast(array() as array<struct<`{order}`:{kind_of},`{out}`:array<double>>>)").alias("all"))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("v"))))
    grouped = df.groupBy(*keys).agg(items.alias("_i"))
    rows = grouped.select(*keys, F.explode(F.aggregate("_i", start, one, lambda s: s["all"])).alias("_r"))
    return rows.select(*keys, F.col("_r")[order].alias(order), F.col("_r")[out].alias(out))
