"""Array functions: definitions over coordinates, lowered to DataFrame plans on demand.

    x, y = Var("x"), Var("y")
    f = Func("f"); f[x, y] = img[x - 1, y] + img[x, y] + img[x + 1, y]
    f.realize([(0, 100), (0, 50)], spark)

Asking for a region works backwards: pure functions are substituted into their
consumers, the region that each remaining array has to supply follows from its index
expressions, inputs are filtered to it, and calls become joins on computed
coordinates.  Updates become grouped aggregates where their form is associative,
stores of the last writer where they do not read themselves, and ordered folds for
recurrences along one or two reduction variables.
"""

from __future__ import annotations

from functools import reduce as reduce_
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.expr import Expr, Undef, cast, const
from ..functions.types import F64, I32, ElementType
from ..operators.halo import gather
from ..operators.reduce import associative, wrapped_scan
from ..operators.table import ArrayTable, domain
from . import region as R
from .region import Box, Range, box, interval, shift_of

_ids = count()


def Var(name: str | None = None) -> Expr:
    return Expr(I32, name=name or f"v{next(_ids)}")


#: Stands for all coordinates that are not named: ``f[x, _] = g[_] + 1`` .
_ = Expr(I32, name="_")


class Param(Expr):
    """A scalar that gets its value after the pipeline has been built; its range is
    checked where it is set."""

    def __init__(self, type: ElementType, value=None, min=None, max=None, name: str | None = None):
        self.low, self.high = min, max
        super().__init__(type, tag=f"param:{name or next(_ids)}")
        if value is not None:
            self.set(value)

    def set(self, value) -> None:
        if not self.type.can_hold(value) or self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{value} is not a {self.type} in {self.low}..{self.high}")
        self.value = float(value) if self.type.is_float else bool(value) if self.type.is_bool else int(value)

    def get(self):
        return self.value

    def column(self, bind=None) -> Column:
        if self.value is None:
            raise ValueError("the parameter has no value")
        return super().column(bind)


class RVar(Expr):
    def __init__(self, name: str, rdom: "RDom"):
        super().__init__(I32, name=name)
        self.rdom = rdom


class RDom:
    """A reduction domain of (min, extent) pairs; the first dimension runs fastest."""

    def __init__(self, ranges, name: str | None = None):
        name = name or f"r{next(_ids)}"
        self.box = box(*ranges)
        self.vars = [RVar(f"{name}_{i}", self) for i in range(len(self.box))]
        self.predicates: list[Expr] = []
        self.frozen = False

    def where(self, cond: Expr) -> None:
        if self.frozen:
            raise RuntimeError("the domain has been used by a definition")
        self.predicates.append(E._bool(cond))

    def __getitem__(self, i: int) -> RVar:
        return self.vars[i]

    x = property(lambda self: self.vars[0])
    y = property(lambda self: self.vars[1])
    z = property(lambda self: self.vars[2])


class Image:
    """An input array: a table, its rank and element types checked where it is bound."""

    def __init__(self, table: ArrayTable | None = None, dims: int | None = None, type: ElementType | None = None):
        self.rank, self.type, self.table = dims, type, None
        if table is not None:
            self.set(table)

    def set(self, table: ArrayTable) -> None:
        if self.rank is not None and len(table.dims) != self.rank:
            raise TypeError(f"an array of {self.rank} dimensions is wanted, not {len(table.dims)}")
        if self.type is not None and table.types[0] != self.type:
            raise TypeError(f"{self.type} is wanted, not {table.types[0]}")
        self.table, self.rank = table, len(table.dims)

    def __getitem__(self, index) -> Expr:
        index = index if isinstance(index, tuple) else (index,)
        if len(index) != self.rank:
            raise TypeError(f"{len(index)} coordinates for {self.rank} dimensions")
        calls = tuple(Expr(t, tuple(_index(i) for i in index), call=(self, k)) for k, t in enumerate(self.table.types))
        return calls[0] if len(calls) == 1 else calls

    def covers(self, need: Box) -> None:
        own = self.table.region
        if own is not None and not all(o.contains(n) for o, n in zip(own, need)):
            raise IndexError(f"the input covers {own}, but {need} is read")


def _index(i) -> Expr:
    return i if isinstance(i, Expr) else const(i, I32)


class Update:
    """One store; ``lanes`` holds the others of a scatter, which read before any writes."""

    def __init__(self, lhs: list[Expr], rhs: list[Expr | Undef], lanes: "tuple[Update, ...]" = ()):
        self.lhs, self.rhs, self.lanes = lhs, rhs, lanes

    def exprs(self) -> list[Expr]:
        own = [*self.lhs, *(v for v in self.rhs if isinstance(v, Expr))]
        return own + [e for u in self.lanes for e in u.exprs()]


class Func:
    """A named total function of integer coordinates to one or several values."""

    def __init__(self, name: str | Expr | None = None):
        body = name if isinstance(name, Expr) else None
        self.name = name if isinstance(name, str) else f"f{next(_ids)}"
        self.args: list[str] = []
        self.values: list[Expr] = []
        self.updates: list[Update] = []
        self.root = self.frozen = self.kept = False
        self.required: list[tuple[Expr, str]] = []
        self.special: list[Expr] = []
        self.passes: list = []
        self.bounds: dict[str, tuple] = {}
        self.by: tuple[str, ...] = ()
        self.made: dict = {}
        if body is not None:  # a function of the expression's variables, in the order of their names
            free = sorted({n.name for n in body.nodes() if n.name is not None and not isinstance(n, RVar)})
            self[tuple(Expr(I32, name=n) for n in free)] = body

    # definitions -------------------------------------------------------------
    def __setitem__(self, index, value) -> None:
        index = [i if isinstance(i, E.Lanes) else _index(i) for i in (index if isinstance(index, tuple) else (index,))]
        values = list(value) if isinstance(value, tuple) else [value]
        lanes = [i for i in [*index, *values] if isinstance(i, E.Lanes)]
        if lanes:
            n = len(lanes[0].items)
            if any(len(x.items) != n for x in lanes):
                raise TypeError("scatters and gathers of one store have equally many lanes")
            pick = lambda x, k: x.items[k] if isinstance(x, E.Lanes) else x
            if not self.values:
                raise TypeError("scatters are updates")
            stores = [self._update([_index(pick(i, k)) for i in index], [pick(v, k) for v in values]) for k in range(n)]
            self.updates.append(Update(stores[0].lhs, stores[0].rhs, tuple(stores[1:])))
            return
        if not self.values:
            index, values = _implied(index, values)
        pure = all(i.name is not None and not isinstance(i, RVar) for i in index) and len({i.name for i in index}) == len(index)
        if not self.values:
            rvars = [n for v in values if isinstance(v, Expr) for n in v.nodes() if isinstance(n, RVar)]
            if not pure or rvars:
                raise TypeError("the first definition takes distinct variables")
            args, new = [i.name for i in index], [v if isinstance(v, Expr) else const(v) for v in values]
            free = {n.name for v in new for n in v.nodes() if n.name} - set(args)
            if free:
                raise NameError(f"undefined variables {sorted(free)}")
            self.args, self.values = args, new
            return
        self.updates.append(self._update(index, values))

    def _update(self, index: list[Expr], values: list) -> Update:
        if self.frozen:
            raise RuntimeError(f"{self.name} has been used and cannot change")
        if len(index) != len(self.args) or len(values) != len(self.values):
            raise TypeError("an update has the rank and the number of values of the definition")
        out = Update(index, [v if isinstance(v, Undef) else cast(o.type, v) if not (isinstance(v, Expr) and v.type != o.type and v.type.is_float and not o.type.is_float) else _mismatch() for v, o in zip(values, self.values)])
        for e in [*index, *(v for v in values if isinstance(v, Expr))]:
            for n in e.nodes():
                if isinstance(n, RVar):
                    n.rdom.frozen = True
        return out

    def _undefined(self, index: tuple) -> "Expr":
        """A call of a function without a definition, which ``+=`` and the like turn into one:
        its start is 0 for sums and 1 for products."""
        return _Start(self, index)

    def __getitem__(self, index):
        index = index if isinstance(index, tuple) else (index,)
        if not self.values:
            return self._undefined(index)
        if any(isinstance(i, Expr) and i.name == "_" for i in index):
            at = next(k for k, i in enumerate(index) if isinstance(i, Expr) and i.name == "_")
            named = [i for i in index if not (isinstance(i, Expr) and i.name == "_")]
            missing = len(self.args) - len(named)
            index = (*index[:at], *[Expr(I32, name=f"_{k}") for k in range(missing)], *index[at + 1 :])
        if len(index) != len(self.args):
            raise TypeError(f"{len(index)} coordinates for {len(self.args)} dimensions")
        calls = tuple(Expr(v.type, tuple(_index(i) for i in index), call=(self, k)) for k, v in enumerate(self.values))
        return calls[0] if len(calls) == 1 else calls

    # schedule: results never change --------------------------------------------
    def compute_root(self) -> "Func":
        self.root = True
        return self

    store_root = compute_at = store_at = hoist_storage = hoist_storage_root = lambda self, *_: self.compute_root()

    def memoize(self, *_) -> "Func":
        """The table of a region is made once and kept on the executors' disks."""
        self.kept = True
        return self.compute_root()

    def compute_inline(self, *_) -> "Func":
        self.root = False
        return self

    def tile_by(self, *dims: str) -> "Func":
        """Partition the realized table by these coordinates."""
        self.by = dims
        return self

    def _same(self, *_, **__) -> "Func":
        """A directive about loops, storage or tracing: plans have neither."""
        return self

    split = fuse = tile = reorder = rename = serial = parallel = vectorize = unroll = partition = never_partition = always_partition = _same
    reorder_storage = align_storage = bound_storage = fold_storage = store_in = set_estimate = set_estimates = _same
    async_ = ring_buffer = prefetch = atomic = allow_race_conditions = stream_loads = stream_stores = unscheduled = compute_with = _same
    trace_loads = trace_stores = trace_realizations = add_trace_tag = no_profiling = eager_inline = _same

    def bound(self, var, min, extent) -> "Func":
        """The coordinate's region is stated; other regions are refused."""
        self.bounds[_var_name(var)] = (min, extent)
        return self

    def bound_extent(self, var, extent) -> "Func":
        return self.bound(var, None, extent)

    def align_bounds(self, var, modulus: int, remainder: int = 0) -> "Func":
        """The computed region grows to a multiple; the asked one is returned."""
        return self

    align_extent = align_bounds

    def specialize(self, cond: Expr) -> "Func":
        """A case of its own, which computes the same; see ``specialize_fail``."""
        self.special.append(E._bool(cond))
        return self

    def specialize_fail(self, message: str) -> None:
        """An error where none of the cases specialized before holds."""
        self.required.append((E.logical_or(E.const(False), *self.special), message))

    def in_(self, *_) -> "Func":
        """A wrapper with the same values; consumers may use either."""
        g = Func()
        args = tuple(Expr(I32, name=a) for a in self.args)
        g[args] = self[args]
        return g

    clone_in = in_

    def change_type(self, type: ElementType) -> "Func":
        """A wrapper whose sums are accumulated in another type and cast back."""
        if len(self.values) != 1 or self.frozen:
            raise RuntimeError("one value that has not been used changes its type")
        g, args, old = Func(), tuple(Expr(I32, name=a) for a in self.args), self.values[0].type
        g[args] = cast(type, self.values[0])
        for u in self.updates:
            g[tuple(u.lhs)] = cast(type, _recast(self, g, u.rhs[0], type))
        out = Func()
        out[args] = cast(old, g[args])
        return out

    def rfactor(self, preserved: dict["RVar", Expr]) -> "Func":
        """Makes the last update, which has to be associative, two of them: partial results
        for each value of the preserved variables, which it returns, and then theirs."""
        u = self.updates[-1]
        kind = _associative(self, u)
        if kind is None:
            raise ValueError("only associative updates are factored")
        rdom, = _rdom(u)
        stays = {r.name: v for r, v in preserved.items()}
        part, args = Func(), [Expr(I32, name=a) for a in self.args]
        identity = {"add": 0, "mul": 1, "and": True, "or": False, "bitor": 0, "bitxor": 0}
        starts = [v.type.min if kind[0].get(k) == "max" else v.type.max if kind[0].get(k) in ("min", "bitand") and not v.type.is_int else -1 if kind[0].get(k) == "bitand" else v.type.max if kind[0].get(k) == "min" else identity[kind[0][k]] for k, v in enumerate(self.values)]
        part[(*args, *stays.values())] = tuple(cast(v.type, const(float(x) if v.type.is_float else bool(x) if v.type.is_bool else int(x), v.type)) for x, v in zip(starts, self.values))
        # the preserved variables become coordinates; the rest is reduced, within the same predicate
        left = [(v, b) for v, b in zip(rdom.vars, rdom.box) if v.name not in stays]
        inner = RDom([(b.min, b.extent) for _, b in left] or [(0, 1)])
        put = {v.name: n for (v, _), n in zip(left, inner.vars)} | stays
        move = lambda e: e.rebuild(lambda n: put.get(n.name) if n.name is not None else None)
        for p in rdom.predicates:
            inner.predicates.append(move(p))
        if not left:
            inner.predicates.append(inner[0] == 0)
        for v, b in zip(rdom.vars, rdom.box):
            if v.name in stays:
                inner.predicates.append(E.logical_and(stays[v.name] >= b.min, stays[v.name] <= b.max))
        place = (*[move(i) for i in u.lhs], *stays.values())
        part[place] = tuple(_OPS[kind[0][k]](_item(part[place], k), move(kind[1][k])) for k in range(len(self.values)))
        part.updates[-1].rdoms = [inner]
        outer = RDom([(b.min, b.extent) for v, b in zip(rdom.vars, rdom.box) if v.name in stays])
        names = [v.name for v in rdom.vars if v.name in stays]
        last = dict(zip(names, outer.vars))
        self.updates.pop()
        whole = tuple(Expr(I32, name=a) for a in self.args)
        call = part[(*whole, *[last[r.name] for r in preserved])]
        self[whole] = tuple(_OPS[kind[0][k]](_item(self[whole], k), _item(call, k)) for k in range(len(self.values)))
        part.compute_root()
        return part

    def print_loop_nest(self) -> str:
        """How the function is made, a line a stage."""
        lines = [f"produce {self.name}({', '.join(self.args)})" + (" as a table" if self.root or self.updates else " inline")]
        for u in self.updates:
            how = "aggregate" if _associative(self, u) else "last writer" if not _Lowering.reads_itself(self, u) else "in place" if not _rdom(u) else "ordered fold"
            lines.append(f"  update over {[v.name for d in _rdom(u) for v in d.vars]}: {how}")
        return "\n".join(lines)

    def debug_to_file(self, region, spark: SparkSession, path: str) -> ArrayTable:
        """Realizes, and dumps the table as Parquet on the way."""
        out = self.realize(region, spark)
        out.df.write.mode("overwrite").parquet(path)
        return out

    def add_custom_lowering_pass(self, rewrite) -> "Func":
        """``rewrite`` maps every expression to one of its type before it becomes columns, in
        a request for this function; passes run in the order in which they were added."""
        self.passes.append(rewrite)
        return self

    def add_requirement(self, cond: Expr, message: str = "requirement failed") -> None:
        """Checked at each point."""
        self.required.append((cond, message))

    # evaluation ----------------------------------------------------------------
    def realize(self, region, spark: SparkSession) -> ArrayTable:
        r = box(*region)
        for a, n in zip(self.args, r):
            low, extent = self.bounds.get(a, (None, None))
            if extent is not None and (n.extent != extent or low is not None and n.min != low):
                raise IndexError(f"{a} is bound to {extent} places" + (f" from {low} on" if low is not None else ""))
        return _Lowering(spark, tuple(self.passes)).array(self, r)

    def infer_input_regions(self, region) -> dict["Image", Box]:
        """The box that each input has to supply."""
        need: dict = {}
        todo = [(self, box(*region))]
        while todo:
            f, r = todo.pop()
            for call, env in _calls_of(f, r):
                target, b = call.call[0], tuple(Range(lo, hi - lo + 1) for lo, hi in (interval(a, env) for a in call.args))
                grown = R.union(need.get(target), b)
                if grown != need.get(target):
                    need[target] = grown
                    if isinstance(target, Func) and target is not f:
                        todo.append((target, grown))
        return {k: v for k, v in need.items() if isinstance(k, Image)}


class _Start(Expr):
    """See ``Func._undefined``."""

    def __init__(self, f: Func, index: tuple):
        super().__init__(I32)
        self.f, self.index = f, index

    def _define(self, value, start: int, op):
        f, index = self.f, tuple(_index(i) for i in self.index)
        values = value if isinstance(value, tuple) else (value,)
        values = tuple(v if isinstance(v, Expr) else const(v) for v in values)
        args = tuple(i if i.name is not None and not isinstance(i, RVar) else Var() for i in index)
        zeros = tuple(const(float(start) if v.type.is_float else start, v.type) for v in values)
        f[args] = zeros if len(zeros) > 1 else zeros[0]
        old = f[index]
        news = tuple(op(o, v) for o, v in zip(old if isinstance(old, tuple) else (old,), values))
        return news if len(news) > 1 else news[0]

    def __iadd__(self, v): return self._define(v, 0, lambda a, b: a + b)  # noqa: E704
    def __isub__(self, v): return self._define(v, 0, lambda a, b: a - b)  # noqa: E704
    def __imul__(self, v): return self._define(v, 1, lambda a, b: a * b)  # noqa: E704
    def __itruediv__(self, v): return self._define(v, 1, lambda a, b: a / b)  # noqa: E704

    def nodes(self):
        raise NameError(f"{self.f.name} is not defined")


def evaluate(e: Expr, spark: SparkSession):
    """The value of an expression without variables."""
    f = Func()
    f[Var()] = e
    return f.realize([1], spark).at(0)


def _implied(index: list[Expr], values: list) -> tuple[list[Expr], list]:
    """``_`` on the left stands for as many coordinates as the calls on the right leave."""
    at = next((k for k, i in enumerate(index) if i.name == "_"), None)
    if at is None:
        return index, values
    n = max((int(v.name[1:]) + 1 for e in values if isinstance(e, Expr) for v in e.nodes() if v.name and v.name[0] == "_" and v.name[1:].isdigit()), default=0)
    return [*index[:at], *[Expr(I32, name=f"_{k}") for k in range(n)], *index[at + 1 :]], values


def _var_name(var) -> str:
    return var if isinstance(var, str) else var.name


def _item(call, k: int) -> Expr:
    return call[k] if isinstance(call, tuple) else call


def _recast(f: Func, g: Func, e: Expr, type: ElementType) -> Expr:
    """Reads of f become reads of g, and the arithmetic around them its type."""
    if e.call is not None and e.call[0] is f:
        return g[e.args]
    if e.tag in _OPS and any(n.call is not None and n.call[0] is f for n in e.nodes()):
        return _OPS[e.tag](*[_recast(f, g, a, type) if any(n.call is not None and n.call[0] is f for n in a.nodes()) else cast(type, a) for a in e.args])
    return e


#: Operations of associative updates.
_OPS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "max": E.max_, "min": E.min_, "and": E.logical_and, "or": E.logical_or,
    "bitand": lambda a, b: a & b, "bitor": lambda a, b: a | b, "bitxor": lambda a, b: a ^ b,
}


def _mismatch():
    raise TypeError("an update has the types of the definition")


def _calls_of(f: Func, r: Box):
    env = dict(zip(f.args, r))
    for v in f.values:
        for n in v.nodes():
            if n.call is not None:
                yield n, env
    for u in f.updates:
        rdom = _rdom(u)
        uenv = {i.name: env[a] for i, a in zip(u.lhs, f.args) if i.name is not None and not isinstance(i, RVar)}
        uenv |= {v.name: b for d in rdom for v, b in zip(d.vars, d.box)}
        for e in u.exprs():
            for n in e.nodes():
                if n.call is not None and n.call[0] is not f:
                    yield n, uenv


def _rdom(u: Update) -> list[RDom]:
    found = {id(d): d for d in getattr(u, "rdoms", ())}
    for e in u.exprs():
        for n in e.nodes():
            if isinstance(n, RVar):
                found[id(n.rdom)] = n.rdom
    return list(found.values())


class _Lowering:
    """One realization.  A table that several consumers read over one region is one plan,
    whose exchanges Spark runs once."""

    def __init__(self, spark: SparkSession, passes: tuple = ()):
        self.spark, self.passes = spark, passes
        self.made: dict[tuple, ArrayTable] = {}

    def array(self, f: Func | Image, need: Box) -> ArrayTable:
        key = (id(f), need)
        if key not in self.made:
            kept = f.made if isinstance(f, Func) and f.kept else {}
            if need in kept:
                self.made[key] = kept[need]
            else:
                self.made[key] = self.make(f, need)
                if isinstance(f, Func) and f.kept:
                    self.made[key] = kept[need] = self.made[key]._with(self.made[key].df.persist(StorageLevel.DISK_ONLY))
        return self.made[key]

    def make(self, f: Func | Image, need: Box) -> ArrayTable:
        if isinstance(f, Image):
            f.covers(need)
            t = f.table
            for d, r in zip(t.dims, need):
                t = t.crop(d, r.min, r.extent)
            return t
        f.frozen = True
        whole = need
        for u in f.updates:  # a scan reads where it starts: its own domain is computed in full
            env = {v.name: b for d in _rdom(u) for v, b in zip(d.vars, d.box)}
            env |= {i.name: r for i, r in zip(u.lhs, need) if i.name is not None and not isinstance(i, RVar)}
            reads = [n.args for v in u.exprs() for n in v.nodes() if n.call is not None and n.call[0] is f]
            for index in [u.lhs, *[x.lhs for x in u.lanes], *reads]:
                if self.reads_itself(f, u):
                    whole = R.union(whole, tuple(Range(lo, hi - lo + 1) for lo, hi in (interval(i, env) for i in index)))
        dims, vals = tuple(f.args), tuple(f"{f.name}_{k}" if len(f.values) > 1 else "v" for k in range(len(f.values)))
        df = self.points(domain(self.spark, list(dims), whole), dict(zip(dims, whole)), [*f.values, *(c for c, _ in f.required)])
        cols = [c.cast(v.type.spark).alias(n) for c, v, n in zip(df[1], f.values, vals)]
        table = df[0]
        for c, (_, message) in zip(df[1][len(f.values) :], f.required):
            cols[0] = F.when(c, cols[0]).otherwise(F.raise_error(F.lit(message)).cast(f.values[0].type.spark)).alias(vals[0])
        table = table.select(*dims, *cols)
        for u in f.updates:
            table = self.update(f, u, table, dims, vals, whole)
        for d, w, n in zip(dims, whole, need):
            if w != n:
                table = table.where(F.col(d).between(n.min, n.max))
        if f.by:
            table = table.repartition(*f.by)
        return ArrayTable(table, dims, vals, tuple(v.type for v in f.values), need)

    def inlined(self, e: Expr) -> Expr:
        """Pure functions replaced by their bodies with the arguments put in."""

        def step(n: Expr) -> Expr | None:
            if n.call is None or not isinstance(n.call[0], Func):
                return None
            f, k = n.call
            if f.root or f.updates:
                return None
            f.frozen = True
            put = dict(zip(f.args, n.args))
            return self.inlined(f.values[k].rebuild(lambda m: put.get(m.name) if m.name is not None else None))

        return e.rebuild(step)

    def rewritten(self, e: Expr) -> Expr:
        for rewrite in self.passes:
            new = rewrite(e)
            if new.type != e.type:
                raise TypeError("a pass keeps types")
            e = new
        return e

    def points(self, df: DataFrame, env: dict[str, Range], exprs: list[Expr], own: tuple | None = None) -> tuple[DataFrame, list[Column]]:
        """The points' table with columns for all calls in ``exprs``, and the expressions'
        columns over it.  ``own`` is (func, table): calls of a function under update."""
        exprs = [self.rewritten(self.inlined(e)) for e in exprs]
        bound: dict[int, Column] = {}
        sites: list[tuple[Expr, str]] = []

        def visit(e: Expr) -> None:
            for a in e.args:
                visit(a)
            if e.call is None:
                return
            for other, name in sites:
                if other.same(e):
                    bound[id(e)] = F.col(name)
                    return
            sites.append((e, f"_c{next(_ids)}"))
            bound[id(e)] = F.col(sites[-1][1])

        for e in exprs:
            visit(e)
        need: dict[int, tuple] = {}
        for e, _ in sites:
            target = e.call[0]
            try:
                b = tuple(Range(lo, hi - lo + 1) for lo, hi in (interval(a, env) for a in e.args))
            except R.Unbounded:
                if isinstance(target, Image) and target.table.region is not None:
                    b = target.table.region
                else:
                    raise
            have = need.get(id(target))
            need[id(target)] = (target, R.union(have[1] if have else None, b))
        tables = {k: own[1] if own and t is own[0] else self.array(t, b) for k, (t, b) in need.items()}
        groups: dict[tuple, list[tuple[Expr, str]]] = {}
        for e, name in sites:  # calls of one array at one place are one join
            key = next((k for k in groups if k[0] == id(e.call[0]) and all(a.same(b) for a, b in zip(groups[k][0][0].args, e.args))), (id(e.call[0]), name))
            groups.setdefault(key, []).append((e, name))
        # calls at constant distances from the point, over the same variables: one exchange for all of them
        near: dict[tuple, list] = {}
        for key, calls in groups.items():
            direct = [shift_of(x) for x in calls[0][0].args]
            if all(direct) and len({v for v, _ in direct}) == len(direct) and all(v in df.columns for v, _ in direct):
                near.setdefault(tuple(sorted(v for v, _ in direct)), []).append((key, dict(direct), [v for v, _ in direct]))
        for over, found in near.items():
            if len(found) < 2:
                continue
            reads: dict[tuple, tuple] = {}
            for key, by, order in found:
                t = tables[key[0]]
                for e, name in groups.pop(key):
                    value = t.values[e.call[1]]
                    cells = t.df.select(*[F.col(d).alias(v) for d, v in zip(t.dims, order)], F.col(value).alias("_value"))
                    reads.setdefault((key[0], value, tuple(order)), (cells, "_value", []))[2].append((tuple(by[v] for v in over), name))
            df = gather(df, list(over), list(reads.values()))
        for (tid, __), calls in groups.items():
            t, first = tables[tid], calls[0][0]
            keys = [f"_k{next(_ids)}" for __ in t.dims]
            src = t.df.select(*[F.col(d).alias(k) for d, k in zip(t.dims, keys)], *[F.col(t.values[e.call[1]]).alias(n) for e, n in calls])
            direct = [shift_of(a) for a in first.args]
            if all(direct) and len({d[0] for d in direct}) == len(direct) and all(d[0] in df.columns for d in direct):
                # variable + constant: the source's coordinates are moved, so the join is on plain columns
                moved = src.select(*[(F.col(k) - c).cast("int").alias(v) for k, (v, c) in zip(keys, direct)], *[n for __, n in calls])
                df = df.join(moved, [v for v, __ in direct], "left")
            else:
                at = [a.column(lambda n: bound.get(id(n))) for a in first.args]
                df = df.join(src, [F.col(k) == c.cast("int") for k, c in zip(keys, at)], "left").drop(*keys)
        return df, [e.column(lambda n: bound.get(id(n))) for e in exprs]

    @staticmethod
    def reads_itself(f: Func, u: Update) -> bool:
        return any(n.call is not None and n.call[0] is f for v in u.exprs() for n in v.nodes())

    def update(self, f: Func, u: Update, table: DataFrame, dims, vals, whole: Box) -> DataFrame:
        rdoms = _rdom(u)
        pure = [(i.name, r) for i, r in zip(u.lhs, whole) if i.name is not None and not isinstance(i, RVar)]
        rvars = [(v.name, b) for d in rdoms for v, b in zip(d.vars, d.box)]
        env = dict(pure + rvars)
        order = F.lit(0).cast("bigint")
        for name, r in reversed(rvars):
            order = order * r.extent + (F.col(name) - r.min)
        preds = [p for d in rdoms for p in d.predicates]
        kind = _associative(f, u)
        own = (f, ArrayTable(table, dims, vals, tuple(v.type for v in f.values)))
        if kind is not None:
            got = self.stores(env, preds, u.lhs, dict(kind[1]), dims)
            exact = {k: f.values[k].type for k in kind[1] if kind[0][k] == "mul" and not f.values[k].type.is_float}
            if exact:  # products wrap: they are folded, bit for bit
                op = {k: _OPS[kind[0][k]] for k in kind[1]}
                one = {"add": 0, "mul": 1, "and": True, "or": False, "max": None, "min": None}
                typed = lambda c, k: Expr(f.values[k].type, (), lambda c=c: c)
                start = {f"_a{k}": F.lit(one[kind[0][k]]).cast(f.values[k].type.spark) for k in kind[1]}

                def combine(p, q):
                    return {f"_a{k}": F.coalesce(op[k](typed(p[f"_a{k}"], k), typed(q[f"_a{k}"], k)).column(), p[f"_a{k}"], q[f"_a{k}"]) for k in kind[1]}

                got = associative(got, list(dims), {f"_a{k}": F.col(f"_e{k}").cast(f.values[k].type.spark) for k in kind[1]}, start, combine)
            else:
                aggs = {"add": F.sum, "mul": F.product, "div": F.product, "max": F.max, "min": F.min, "and": F.bool_and, "or": F.bool_or, "bitand": F.bit_and, "bitor": F.bit_or, "bitxor": F.bit_xor}
                got = got.groupBy(*dims).agg(*[aggs[kind[0][k]](F.col(f"_e{k}").cast("bigint") if kind[0][k].startswith("bit") else _exact(F.col(f"_e{k}"), f.values[k].type)).alias(f"_a{k}") for k in kind[1]])
            table = table.join(got, list(dims), "left")
            put = {}
            for k in kind[1]:
                t = f.values[k].type
                old = Expr(t, name=vals[k])
                agg = Expr(t, (), lambda k=k, t=t: _back(F.col(f"_a{k}"), t))
                new = old / agg if kind[0][k] == "div" else _OPS[kind[0][k]](old, agg)
                put[vals[k]] = F.when(F.col(f"_a{k}").isNull(), F.col(vals[k])).otherwise(new.column())
            return table.withColumns(put).select(*dims, *vals)
        if not self.reads_itself(f, u) or u.lanes and not rdoms:
            # every lane reads the table as it is; of the stores to one place the last stays
            parts = []
            for n, lane in enumerate((u, *u.lanes)):
                live = {k: v for k, v in enumerate(lane.rhs) if isinstance(v, Expr)}
                got = self.stores(env, preds, lane.lhs, live, dims, own, (order * (len(u.lanes) + 1) + n).alias("_o"))
                parts.append(got.select(*dims, "_o", *[(F.col(f"_e{k}").cast(v.type.spark) if k in live else F.lit(None).cast(v.type.spark)).alias(f"_e{k}") for k, v in enumerate(f.values)]))
            got, live = reduce_(DataFrame.union, parts), [k for k, v in enumerate(u.rhs) if isinstance(v, Expr)]
            last = got.groupBy(*dims).agg(F.max_by(F.struct(*[f"_e{k}" for k in live]), "_o").alias("_l"))
            table = table.join(last, list(dims), "left")
            new = {vals[k]: F.when(F.col("_l").isNull(), F.col(vals[k])).otherwise(F.col(f"_l._e{k}")) for k in live}
            return table.withColumns(new).select(*dims, *vals)
        live = {k: v for k, v in enumerate(u.rhs) if isinstance(v, Expr)}
        if not rdoms and all(i.name is not None for i in u.lhs):  # f[x] = g(f[x], ...): in place, by the definition's names
            names = {i.name: d for i, d in zip(u.lhs, dims)}
            renamed = [v.rebuild(lambda n: Expr(I32, name=names[n.name]) if n.name in names else None) for v in live.values()]
            df, cols = self.points(table, dict(zip(dims, whole)), renamed, own=own)
            return df.select(*dims, *[c.cast(f.values[k].type.spark).alias(vals[k]) for k, c in zip(live, cols)], *[v for k, v in enumerate(vals) if k not in live]).select(*dims, *vals)
        if not rdoms:
            got = self.stores(env, preds, u.lhs, live, dims, own, F.lit(0).alias("_o"))
            table = table.join(got, list(dims), "left")
            new = {vals[k]: F.when(F.col("_o").isNull(), F.col(vals[k])).otherwise(F.col(f"_e{k}").cast(f.values[k].type.spark)) for k in live}
            return table.withColumns(new).select(*dims, *vals)
        if u.lanes:
            raise NotImplementedError("lanes that read what an earlier step of a reduction stored")
        if all(all(a.same(b) for a, b in zip(n.args, u.lhs)) for v in live.values() for n in v.nodes() if n.call is not None and n.call[0] is f):
            return self.in_place(f, u, table, dims, vals, env, order, preds, live)
        return self.recurrence(f, u, table, dims, vals, rdoms, preds, whole, live)

    def stores(self, env: dict, preds: list[Expr], lhs: list[Expr], rhs: dict[int, Expr], dims, own: tuple | None = None, *more: Column) -> DataFrame:
        """The update's points with the place that each stores to and its values _e{k}."""
        base = domain(self.spark, list(env), tuple(env.values()))
        if preds:
            df, cols = self.points(base, env, preds, own)
            for c in cols:
                df = df.where(c)
            base = df.select(*env)
        df, cols = self.points(base, env, [*lhs, *rhs.values()], own)
        return df.select(*[c.cast("int").alias(d) for d, c in zip(dims, cols)], *more, *[c.alias(f"_e{k}") for k, c in zip(rhs, cols[len(dims) :])])

    def in_place(self, f, u, table, dims, vals, env, order, preds, live) -> DataFrame:
        """f[k(r)] = g(f[k(r)], r): steps on the same place, folded in the order of r.  The
        steps of one place are one array."""
        reads, outer = [], {}
        for k, v in live.items():
            def step(n: Expr) -> Expr | None:
                if n.call is not None and n.call[0] is f:
                    return Expr(n.type, name=f"_own{n.call[1]}")
                return None

            outer[k] = self.inlined(v.rebuild(step))
        leaves = {}
        for v in outer.values():
            for n in v.nodes():
                if n.call is not None and not any(n.same(x) for x in leaves.values()):
                    leaves[len(leaves)] = n
        names = sorted({n.name for v in outer.values() for n in v.nodes() if n.name in env})
        got = self.stores(env, preds, u.lhs, leaves, dims, None, order.alias("_o"), *[F.col(n).alias(f"_n_{n}") for n in names])
        steps = got.groupBy(*dims).agg(F.array_sort(F.collect_list(F.struct("_o", *[f"_e{i}" for i in leaves], *[f"_n_{n}" for n in names]))).alias("_s"))
        joined = table.join(steps, list(dims), "left")
        start = F.struct(*[F.col(v).alias(v) for v in vals])

        def one(acc, it):
            def bind(n: Expr):
                if n.name and n.name.startswith("_own"):
                    return acc[vals[int(n.name[4:])]]
                if n.name in names:
                    return it[f"_n_{n.name}"]
                if n.call is not None:
                    return it[f"_e{next(i for i, x in leaves.items() if x.same(n))}"]
                return None

            return F.struct(*[(outer[k].column(bind).cast(f.values[k].type.spark) if k in outer else acc[v]).alias(v) for k, v in enumerate(vals)])

        done = joined.withColumn("_d", F.when(F.col("_s").isNull(), start).otherwise(F.aggregate("_s", start, one)))
        return done.select(*dims, *[F.col(f"_d.{v}").alias(v) for v in vals])

    def recurrence(self, f, u, table, dims, vals, rdoms, preds, whole, live):
        """f[r, pure...] = F(f[r - k, pure...], ...) along one or two reduction variables: an
        ordered fold, line by line, for each combination of the pure variables.

        Reads of places that the fold has passed see what it stored; reads ahead, and
        outside its domain, see what was there before.  A line is one array, and the lines
        of one combination are one array of them."""
        if len(rdoms) != 1 or len(rdoms[0].vars) > 2:
            raise NotImplementedError("recurrences run along one or two variables of one domain")
        fast, slow = rdoms[0].vars[0], rdoms[0].vars[1] if len(rdoms[0].vars) > 1 else None
        place = {e.name: i for i, e in enumerate(u.lhs)}
        if any(e.name is None for e in u.lhs) or fast.name not in place or slow is not None and slow.name not in place:
            raise NotImplementedError("a recurrence stores at its reduction variables")
        at, up = place[fast.name], place[slow.name] if slow is not None else None
        rng, rng2 = rdoms[0].box[0], rdoms[0].box[1] if slow is not None else Range(0, 1)
        others = [d for i, d in enumerate(dims) if i not in (at, up)]
        names = {e.name: d for e, d in zip(u.lhs, dims)}
        lags: list[tuple[int, int]] = []

        def lag(n: Expr) -> tuple[int, int]:
            found = {}
            for i, (arg, e) in enumerate(zip(n.args, u.lhs)):
                s = shift_of(arg)
                if s is None or s[0] != e.name or s[1] and i not in (at, up):
                    raise NotImplementedError("a recurrence reads at constant distances")
                found[i] = s[1]
            return found[at], found[up] if up is not None else 0

        def outside(e: Expr) -> Expr:
            """Reads of f by their distance, other variables by their dimensions."""
            def step(n: Expr) -> Expr | None:
                if n.call is not None and n.call[0] is f:
                    lags.append(lag(n))
                    return Expr(n.type, name=f"_lag:{n.call[1]}:{lags[-1][0]}:{lags[-1][1]}")
                return Expr(I32, name=names[n.name]) if n.name in names else None

            return self.inlined(e.rebuild(step))

        new, conds = {k: outside(v) for k, v in live.items()}, [outside(p) for p in preds]
        reads = {}
        for v in [*new.values(), *conds]:
            for n in v.nodes():
                if n.call is not None and not any(n.same(x) for x in reads.values()):
                    reads[len(reads)] = n
        # all of the lines' places, the edges that are only read included
        line = table
        if reads:
            line, cols = self.points(table, dict(zip(dims, whole)), list(reads.values()))
            line = line.select(*dims, *vals, *[c.alias(f"_in{i}") for i, c in enumerate(cols)])
        along = _running_sum(new, vals, f, at, up) if not conds and up is not None else None
        if along is not None:
            (k, own), = along[1].items()
            e = own.column(lambda n: F.col(f"_in{next(x for x, r in reads.items() if r.same(n))}") if n.call is not None else None)
            return self.running_sum(line.withColumn("_e", e), along[0], dims, vals, vals[k], f.values[k].type, (at, up), (rng, rng2), others)
        low = F.col(dims[up]) if up is not None else F.lit(0)
        fields = [F.col(dims[at]).alias("p"), low.alias("q"), *[F.col(v) for v in vals], *[F.col(f"_in{i}") for i in reads], *[F.col(d).alias(f"_d_{d}") for d in others]]
        lines = line.groupBy(*others, low.alias("_q")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_l"))
        g = lines.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(F.col("_q").alias("q"), F.col("_l").alias("l")))).alias("_g"))
        kinds = ",".join(f"{v}:{e.type.spark}" for v, e in zip(vals, f.values))
        none, no_lines = F.expr(f"cast(array() as array<struct<{kinds}>>)"), F.expr(f"cast(array() as array<array<struct<{kinds}>>>)")

        def each_line(done, one_line):
            def each(acc, it):
                i, j = F.size(acc), F.size(done)

                def bind(n: Expr):
                    if n.name and n.name.startswith("_lag:"):
                        k, a, b = (int(x) for x in n.name.split(":")[1:])
                        passed = b < 0 or b == 0 and a < 0
                        source = acc if b == 0 and a < 0 else F.get(done, j + b) if passed else one_line["l"] if b == 0 else F.get("_g", j + b)["l"]
                        return F.get(source, i + a)[vals[k]]
                    if n.call is not None:
                        return it[f"_in{next(x for x, r in reads.items() if r.same(n))}"]
                    if n.name == dims[at]:
                        return it["p"]
                    if up is not None and n.name == dims[up]:
                        return it["q"]
                    return it[f"_d_{n.name}"] if n.name in others else None

                on = it["p"].between(rng.min, rng.max) & (it["q"].between(rng2.min, rng2.max) if up is not None else F.lit(True))
                for c in conds:
                    on = on & c.column(bind)
                cell = F.struct(*[(F.when(on, new[k].column(bind).cast(e.type.spark)).otherwise(it[v]) if k in new else it[v]).alias(v) for k, (v, e) in enumerate(zip(vals, f.values))])
                return F.concat(acc, F.array(cell))

            return F.concat(done, F.array(F.aggregate(one_line["l"], none, each)))

        runs = F.flatten(F.aggregate("_g", no_lines, each_line))
        places = F.flatten(F.transform("_g", lambda x: x["l"]))
        out = g.select(*others, F.inline(F.zip_with(places, runs, lambda p, r: F.struct(p["p"].alias("_p"), p["q"].alias("_q"), *[r[v].alias(v) for v in vals]))))
        moved = [(F.col("_p") if i == at else F.col("_q") if i == up else F.col(d)).alias(d) for i, d in enumerate(dims)]
        return out.select(*moved, *vals)


    @staticmethod
    def running_sum(line: DataFrame, steps: tuple[bool, bool], dims, vals, v: str, t: ElementType, places: tuple[int, int], ranges: tuple[Range, Range], others: list[str]) -> DataFrame:
        """Running sums of ``_e`` over the ranges, along one place or both, one after the
        other, from what stands before the ranges on.

        Sums along both start a line with the difference to the start of the line before."""
        (p, q), (a, b) = [dims[i] for i in places], ranges
        inside = F.col(p).between(a.min, a.max) & F.col(q).between(b.min, b.max)
        rows = line.withColumn("_e", F.col("_e").cast(t.spark))
        if steps[0]:
            edge = F.col(p) == a.min - 1
            # 64-bit differences wrap as sums do: the start before is a row of its own, of the opposite sign
            cells = rows.select(*dims, *vals, F.when(edge, F.col(v)).when(inside, F.col("_e")).otherwise(F.lit(0).cast(t.spark)).alias("_e"), F.lit(True).alias("_real"))
            if steps[1]:
                keep = [c for c in cells.columns if c not in (q, "_e", "_real")]
                cell = lambda y, e, real: F.struct(y.cast("int").alias(q), e.alias("_e"), F.lit(real).alias("_real"))
                own, less = cell(F.col(q), F.col("_e"), True), cell(F.col(q) + 1, (E.const(0, t) - E.col(v, t)).column(), False)
                cells = cells.select(*keep, F.inline(F.when(edge & (F.col(q) < b.max), F.array(own, less)).otherwise(F.array(own))))
            rows = wrapped_scan(cells, [q, *others], p, F.col("_e"), t, a.extent + 1, "_e").where("_real").drop("_real")
        if steps[1]:
            start = F.when(F.col(q) == b.min - 1, F.col(v)).when(inside, F.col("_e")).otherwise(F.lit(0).cast(t.spark))
            rows = wrapped_scan(rows.withColumn("_e", start), [p, *others], q, F.col("_e"), t, b.extent + 1, "_e")
        return rows.select(*dims, *[F.when(inside, F.col("_e")).otherwise(F.col(v)).alias(x) if x == v else F.col(x) for x in vals])


def _running_sum(new: dict[int, Expr], vals, f: Func, at: int, up: int):
    """((along the fast variable, along the slow one), {value: what is added up}) if the one
    updated value of a recurrence, whose reads of itself are named by their distances, is
    the sum of that and of the values before it (less the one that both of those have in)."""
    if len(new) != 1:
        return None
    (k, e), = new.items()
    t = f.values[k].type
    if t.is_float or t.is_bool:
        return None
    lags: dict[tuple[int, int], int] = {}
    rest: list[tuple[int, Expr]] = []

    def split(n: Expr, sign: int) -> None:
        whole = not n.type.is_float and n.type.bits >= t.bits  # sums modulo more are sums modulo less
        if whole and n.tag in ("add", "sub"):
            split(n.args[0], sign)
            split(n.args[1], sign if n.tag == "add" else -sign)
        elif whole and (n.tag or "").startswith("cast:") and not n.args[0].type.is_float and n.args[0].type.bits >= t.bits:
            split(n.args[0], sign)
        elif n.name and n.name.startswith(f"_lag:{k}:") and not n.name.endswith(":0:0"):
            a, b = (int(x) for x in n.name.split(":")[2:])
            lags[a, b] = lags.get((a, b), 0) + sign
        else:
            rest.append((sign, n))

    split(e, 1)
    found = {frozenset({((-1, 0), 1)}): (True, False), frozenset({((0, -1), 1)}): (False, True), frozenset({((-1, 0), 1), ((0, -1), 1), ((-1, -1), -1)}): (True, True)}
    steps = found.get(frozenset(lags.items()))
    if steps is None or any(m.name and m.name.startswith("_lag:") and not m.name.endswith(":0:0") for _, n in rest for m in n.nodes()):
        return None
    own = None
    for sign, n in rest:
        n = cast(t, n.rebuild(lambda m: Expr(m.type, name=vals[int(m.name.split(":")[1])]) if m.name and m.name.startswith("_lag:") else None))
        own = (n if sign > 0 else -n) if own is None else own + n if sign > 0 else own - n
    return steps, {k: E.const(0, t) if own is None else own}


def _associative(f: Func, u: Update):
    """({value: kind}, {value: expression}) if every updated value is old (op) e and e
    does not read f."""
    if u.lanes:
        return None
    kinds, rest = {}, {}
    for k, v in enumerate(u.rhs):
        if isinstance(v, Undef):
            continue
        if v.tag not in _OPS and not (v.tag == "div" and v.type.is_float):
            return None
        mine = [i for i, s in enumerate(v.args) if s.call is not None and s.call == (f, k) and all(a.same(b) for a, b in zip(s.args, u.lhs))]
        if len(mine) != 1 or v.tag in ("sub", "div") and mine[0] != 0:
            return None
        e = v.args[1 - mine[0]]
        if any(n.call is not None and n.call[0] is f for n in e.nodes()):
            return None
        kinds[k], rest[k] = ("add", -e) if v.tag == "sub" else (v.tag, e)
    if any(kinds[k] == "mul" and not f.values[k].type.is_float for k in kinds) and any(v in ("bitand", "bitor", "bitxor", "div") for v in kinds.values()):
        return None
    return (kinds, rest) if kinds else None


def _exact(c: Column, t: ElementType) -> Column:
    return c if t.is_float or t.is_bool else c.cast("bigint") if t.bits <= 32 else c.cast("decimal(20,0)")


def _back(c: Column, t: ElementType) -> Column:
    from ..functions.types import wrap

    if t.is_float or t.is_bool:
        return c.cast(t.spark)
    return wrap(c.cast("decimal(38,0)") if t.bits > 32 else c.cast("bigint"), t)


class Pipeline:
    """Several outputs of one request."""

    def __init__(self, *outputs: Func):
        self.outputs = outputs

    def realize(self, region, spark: SparkSession) -> list[ArrayTable]:
        return [f.realize(region, spark) for f in self.outputs]


class Callable_:
    """A pipeline with its inputs as arguments."""

    def __init__(self, f: Func, *inputs: Image):
        self.f, self.inputs = f, inputs

    def __call__(self, region, spark: SparkSession, *tables: ArrayTable) -> ArrayTable:
        if len(tables) != len(self.inputs):
            raise TypeError(f"{len(self.inputs)} inputs are wanted")
        for i, t in zip(self.inputs, tables):
            i.set(t)
        return self.f.realize(region, spark)


def define_extern(table: ArrayTable, fn, schema: str, keys: list[str], dims: tuple[str, ...], types: tuple[ElementType, ...] = (F64,)) -> ArrayTable:
    """A black box over whole groups of a table: ``fn`` maps a pandas frame to one."""
    df = table.df.groupBy(*keys).applyInPandas(fn, schema)
    return ArrayTable(df, dims, tuple(c for c in df.columns if c not in dims), types)


def inline_sum(r: RDom, e: Expr, name: str | None = None) -> Expr:
    return _inline(r, e, 0, lambda a, b: a + b, name)


def inline_product(r: RDom, e: Expr) -> Expr:
    return _inline(r, e, 1, lambda a, b: a * b)


def inline_maximum(r: RDom, e: Expr) -> Expr:
    return _inline(r, e, e.type.min, E.max_)


def inline_minimum(r: RDom, e: Expr) -> Expr:
    return _inline(r, e, e.type.max, E.min_)


def _inline(r: RDom, e: Expr, init, op, name: str | None = None) -> Expr:
    """A reduction inside an expression: an own function of the expression's free variables."""
    inner = {v.name for v in r.vars}
    free = list(dict.fromkeys(n.name for n in e.nodes() if n.name is not None and n.name not in inner))
    f = Func(name)
    args = tuple(Expr(I32, name=a) for a in free) or (const(0, I32),)
    if not free:
        dummy = Var()
        f[dummy] = const(init if e.type.is_float else int(init), e.type)
        f[const(0, I32)] = op(f[const(0, I32)], e)
        return f[const(0, I32)]
    f[args] = const(float(init) if e.type.is_float else int(init), e.type)
    f[args] = op(f[args], e)
    return f[args]
