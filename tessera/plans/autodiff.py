"""Reverse-mode derivatives of typed expressions.

The adjoint of each node is pushed to its children by rules for sums, differences,
products, quotients, minima, maxima, selections, float casts and the math functions
built here; whole-number and bit operations pass no gradient.  An array read at a
computed place receives its adjoint as a grouped sum by that place (``scatter_adjoint``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.expr import Expr, cast, const
from ..functions.types import F64, I32
from ..operators.table import ArrayTable, domain
from .func import Func, Image, _associative, _Lowering, _rdom
from .region import Range, interval, union


def gradients(out: Expr, wrt: list[str]) -> dict[str, Expr]:
    """d out / d column for each named column; zero where it does not matter."""
    zero = const(0.0, out.type)
    total: dict[str, Expr] = {}

    def push(e: Expr, adj: Expr) -> None:
        if e.name is not None:
            total[e.name] = adj if e.name not in total else total[e.name] + adj
            return
        if not e.type.is_float or not e.args:
            return
        tag, a = e.tag or "", e.args
        if tag == "add":
            push(a[0], adj)
            push(a[1], adj)
        elif tag == "sub":
            push(a[0], adj)
            push(a[1], -adj)
        elif tag == "mul":
            push(a[0], adj * a[1])
            push(a[1], adj * a[0])
        elif tag == "div":
            push(a[0], adj / a[1])
            push(a[1], -(adj * a[0] / (a[1] * a[1])))
        elif tag in ("max", "min"):
            first = a[0] >= a[1] if tag == "max" else a[0] <= a[1]
            push(a[0], E.select(first, adj, zero))
            push(a[1], E.select(first, zero, adj))
        elif tag == "select":
            push(a[1], E.select(a[0], adj, zero))
            push(a[2], E.select(a[0], zero, adj))
        elif tag == "abs":
            push(a[0], E.select(a[0] > 0.0, adj, -adj))
        elif tag.startswith("cast:"):
            push(a[0], E.cast(a[0].type, adj) if a[0].type.is_float else adj)
        elif tag.startswith("math:"):
            if tag[5:] not in RULES:
                raise NotImplementedError(f"no derivative of {tag[5:]}")
            push(a[0], adj * RULES[tag[5:]](a[0], e))
        elif tag == "pow":
            push(a[0], adj * a[1] * E.pow_(a[0], a[1] - 1.0))
            if a[1].value is None:
                push(a[1], adj * e * E.log(a[0]))
        elif tag == "atan2":
            square = a[0] * a[0] + a[1] * a[1]
            push(a[0], adj * a[1] / square)
            push(a[1], -(adj * a[0] / square))
        elif tag == "absd":
            push(a[0], E.select(a[0] >= a[1], adj, -adj))
            push(a[1], E.select(a[0] >= a[1], -adj, adj))
        elif tag == "mod":
            push(a[0], adj)
            push(a[1], -(adj * E.floor(a[0] / a[1])))
        else:
            raise NotImplementedError(f"no derivative of {tag or 'this expression'}")

    push(out, const(1.0, out.type))
    return {k: total.get(k, zero) for k in wrt}


#: Derivative of each math function, from its argument and its value.
RULES = {
    "sin": lambda x, v: E.cos(x),
    "cos": lambda x, v: -E.sin(x),
    "exp": lambda x, v: v,
    "log": lambda x, v: 1.0 / x,
    "sqrt": lambda x, v: 0.5 / v,
    "tanh": lambda x, v: 1.0 - v * v,
    "sinh": lambda x, v: E.cosh(x),
    "cosh": lambda x, v: E.sinh(x),
    "atan": lambda x, v: 1.0 / (1.0 + x * x),
    "tan": lambda x, v: 1.0 + v * v,
    "asin": lambda x, v: 1.0 / E.sqrt(1.0 - x * x),
    "acos": lambda x, v: -1.0 / E.sqrt(1.0 - x * x),
    "asinh": lambda x, v: 1.0 / E.sqrt(x * x + 1.0),
    "acosh": lambda x, v: 1.0 / E.sqrt(x * x - 1.0),
    "atanh": lambda x, v: 1.0 / (1.0 - x * x),
    "erf": lambda x, v: 1.1283791670955126 * E.exp(-(x * x)),
    "inverse": lambda x, v: -(v * v),
    "inverse_sqrt": lambda x, v: -0.5 * v / x,
    "fract": lambda x, v: E.const(1.0, x.type),
    "floor": lambda x, v: E.const(0.0, x.type),
    "ceil": lambda x, v: E.const(0.0, x.type),
    "trunc": lambda x, v: E.const(0.0, x.type),
    "rint": lambda x, v: E.const(0.0, x.type),
}


def scatter_adjoint(reads: DataFrame, place: list[str], adjoint: str) -> DataFrame:
    """Adjoint of an array from those of its reads: rows (place..., adjoint) summed by place."""
    return reads.groupBy(*place).agg(F.sum(adjoint).alias(adjoint))


def propagate_adjoints(out: Func, adjoint: ArrayTable, spark: SparkSession) -> dict:
    """Adjoints of all functions and images that ``out`` is made of, from that of ``out``
    itself (a table over its region): {Func or Image: ArrayTable of dims and v}.

    Functions that are made inline are part of their consumers.  The others, last first,
    pass what reached them to each place that they read: the local derivative times the
    adjoint, summed by place.  Pure definitions and sums (``+=``) are followed; places that
    nothing reaches have no row."""
    lowering, adjoints = _Lowering(spark), {out: adjoint}
    for f in _stages(out, lowering):
        own = adjoints.get(f)
        if own is None or isinstance(f, Image):
            continue
        if len(f.values) != 1:
            raise NotImplementedError("adjoints of tuples")
        image = Image(ArrayTable(own.df, own.dims, own.values, (F64,)))
        region = own.region
        found: dict = {}
        env = dict(zip(f.args, region))
        _pass_on(lowering, f.values[0], [Expr(I32, name=a) for a in f.args], env, [], image, found)
        for u in f.updates:
            kind = _associative(f, u)
            if kind is None or kind[0] != {0: "add"}:
                raise NotImplementedError("adjoints pass through pure definitions and sums")
            free = {i.name: r for i, r in zip(u.lhs, region) if i.name in f.args}
            free |= {v.name: b for d in _rdom(u) for v, b in zip(d.vars, d.box)}
            _pass_on(lowering, kind[1][0], u.lhs, free, [p for d in _rdom(u) for p in d.predicates], image, found)
        for target, parts in found.items():
            dims = tuple(f"_d{i}" for i in range(len(parts[0][1])))
            rows = [t for t, _ in parts]
            if target in adjoints:
                rows.append(adjoints[target].df.select(*[F.col(a).alias(b) for a, b in zip(adjoints[target].dims, dims)], F.col("v").alias("_v")))
            total = reduce(DataFrame.union, rows).groupBy(*dims).agg(F.sum("_v").alias("v"))
            names = target.table.dims if isinstance(target, Image) else tuple(target.args)
            box_ = reduce(union, [b for _, b in parts], adjoints[target].region if target in adjoints else None)
            adjoints[target] = ArrayTable(total.select(*[F.col(a).alias(b) for a, b in zip(dims, names)], "v"), tuple(names), ("v",), (F64,), box_)
    return adjoints


def _stages(out: Func, lowering: _Lowering) -> list:
    """The functions that are tables of their own, consumers before what they read."""
    order: list = []

    def visit(f) -> None:
        if any(f is g for g in order):
            return
        if isinstance(f, Func):
            bodies = [*f.values, *(e for u in f.updates for e in u.exprs())]
            for e in bodies:
                for n in lowering.inlined(e).nodes():
                    if n.call is not None and n.call[0] is not f:
                        visit(n.call[0])
        order.append(f)

    visit(out)
    return order[::-1]


def _pass_on(lowering: _Lowering, e: Expr, place: list[Expr], env: dict[str, Range], preds: list[Expr], adjoint: Image, found: dict) -> None:
    """For each read in ``e`` (whose own adjoint stands at ``place``): rows of the place read
    and what reaches it."""
    e = lowering.inlined(e)
    sites: list[Expr] = []

    def visit(n: Expr) -> None:
        if n.call is not None and n.type.is_float and not any(n.same(s) for s in sites):
            sites.append(n)
        for a in n.args if n.call is None else ():
            visit(a)

    visit(e)
    if not sites:
        return
    number = lambda n: next((k for k, s in enumerate(sites) if n.call is not None and n.same(s)), None)
    named = e.rebuild(lambda n: Expr(n.type, name=f"_site{number(n)}") if number(n) is not None else None)
    grads = gradients(named, [f"_site{k}" for k in range(len(sites))])
    back = lambda g: g.rebuild(lambda n: sites[int(n.name[5:])] if n.name and n.name.startswith("_site") else None)
    base = domain(lowering.spark, list(env), tuple(env.values()))
    arrives = adjoint[tuple(place)]
    exprs = [*preds, *[cast(F64, back(grads[f"_site{k}"])) * arrives for k in range(len(sites))], *[a for s in sites for a in s.args]]
    df, cols = lowering.points(base, env, exprs)
    for c in cols[: len(preds)]:
        df = df.where(c)
    cols = cols[len(preds) :]
    at = len(sites)
    for k, s in enumerate(sites):
        n = len(s.args)
        rows = df.select(*[c.cast("int").alias(f"_d{i}") for i, c in enumerate(cols[at : at + n])], cols[k].alias("_v")).where("_v IS NOT NULL")
        reach = tuple(Range(lo, hi - lo + 1) for lo, hi in (interval(a, env) for a in s.args))
        found.setdefault(s.call[0], []).append((rows, reach))
        at += n
