"""Typed scalar expressions over coordinates, columns and array calls.

An ``Expr`` is a small immutable tree that knows its element type and how to build its
Spark column once its leaves are bound.  Leaves are constants, variables (coordinate
columns), existing columns and calls of arrays; everything else is a node with a
function from child columns to a column.  Catalyst folds, prunes and fuses the result.
"""

from __future__ import annotations


from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import (
    F32, I32, U32, Bool, ElementType, Float, Int, UInt, clamp_to, common_type, convert, literal_type, wrap,
)


class Expr:
    def __init__(self, type: ElementType, args: tuple = (), build: Callable | None = None, **leaf):
        self.type, self.args, self.build = type, args, build
        self.name = leaf.get("name")  # a variable's or column's
        self.value = leaf.get("value")  # a constant's
        self.call = leaf.get("call")  # (array, element)
        self.tag = leaf.get("tag")  # what the node is, for rewrites: add, mul, max, ...
        self.quick = leaf.get("quick")  # a cheaper function that gives null where it would be wrong

    def column(self, bind: Callable[["Expr"], Column | None] | None = None) -> Column:
        """The Spark column; ``bind`` may give columns for leaves."""
        bound = bind(self) if bind else None
        if bound is not None:
            return bound
        if self.value is not None:
            if self.type.bits == 64 and self.type.is_uint:
                return F.lit(str(self.value)).cast(self.type.spark)
            return F.lit(self.value).cast(self.type.spark)
        if self.name is not None:
            return F.col(f"`{self.name}`")
        if self.call is not None:
            raise ValueError("an array call has to be bound to a table")
        if self.quick is not None:
            quick, exact = self._both(bind)
            return F.coalesce(quick, wrap(exact, self.type))
        return self.build(*[a.column(bind) for a in self.args])

    def _both(self, bind) -> tuple[Column, Column]:
        """The quick column, and the exact value as a decimal that is still to be wrapped.
        Nodes below that have both stay apart, so a chain is built twice and not twice a
        step; null goes through all of them.  Decimals hold any sum, and one product of
        wrapped factors."""
        quick, exact = [], []
        for a in self.args:
            if a.quick is not None and (bind is None or bind(a) is None):
                q, x = a._both(bind)
                if "mul" in (self.tag, a.tag):
                    x = wrap(x, a.type).cast("decimal(38,0)")
            else:
                q = a.column(bind)
                x = q.cast("decimal(38,0)")
            quick.append(q)
            exact.append(x)
        return self.quick(*quick), {"add": Column.__add__, "sub": Column.__sub__, "mul": Column.__mul__}[self.tag](*exact)

    def rebuild(self, f: Callable[["Expr"], "Expr | None"]) -> "Expr":
        """A copy with the nodes that ``f`` maps replaced, outermost first."""
        new = f(self)
        if new is not None:
            return new
        if not self.args:
            return self
        out = Expr(self.type, tuple(a.rebuild(f) for a in self.args), self.build, name=self.name, value=self.value, call=self.call, tag=self.tag, quick=self.quick)
        return out

    def nodes(self):
        yield self
        for a in self.args:
            yield from a.nodes()

    def same(self, other: "Expr") -> bool:
        """Structural equality."""
        return (
            (self.type, self.name, self.value, self.call, self.tag, len(self.args)) == (other.type, other.name, other.value, other.call, other.tag, len(other.args))
            and (self.build is other.build or self.tag is not None)
            and all(a.same(b) for a, b in zip(self.args, other.args))
        )

    def __bool__(self):
        raise TypeError("an expression has no truth value while it is built; use select, logical_and, logical_or")

    def __add__(self, o): return arith("add", self, o)  # noqa: E704
    def __radd__(self, o): return arith("add", o, self)  # noqa: E704
    def __sub__(self, o): return arith("sub", self, o)  # noqa: E704
    def __rsub__(self, o): return arith("sub", o, self)  # noqa: E704
    def __mul__(self, o): return arith("mul", self, o)  # noqa: E704
    def __rmul__(self, o): return arith("mul", o, self)  # noqa: E704
    def __truediv__(self, o): return arith("div", self, o)  # noqa: E704
    def __rtruediv__(self, o): return arith("div", o, self)  # noqa: E704
    __floordiv__, __rfloordiv__ = __truediv__, __rtruediv__
    def __mod__(self, o): return arith("mod", self, o)  # noqa: E704
    def __rmod__(self, o): return arith("mod", o, self)  # noqa: E704
    # in place the left side keeps its type
    def __iadd__(self, o): return self + cast(self.type, o)  # noqa: E704
    def __isub__(self, o): return self - cast(self.type, o)  # noqa: E704
    def __imul__(self, o): return self * cast(self.type, o)  # noqa: E704
    def __itruediv__(self, o): return self / cast(self.type, o)  # noqa: E704
    def __neg__(self): return arith("sub", const(0, self.type), self)  # noqa: E704
    def __lt__(self, o): return compare("lt", self, o)  # noqa: E704
    def __le__(self, o): return compare("le", self, o)  # noqa: E704
    def __gt__(self, o): return compare("gt", self, o)  # noqa: E704
    def __ge__(self, o): return compare("ge", self, o)  # noqa: E704
    def __eq__(self, o): return compare("eq", self, o)  # noqa: E704
    def __ne__(self, o): return compare("ne", self, o)  # noqa: E704
    __hash__ = object.__hash__
    def __and__(self, o): return bitwise("and", self, o)  # noqa: E704
    def __or__(self, o): return bitwise("or", self, o)  # noqa: E704
    def __xor__(self, o): return bitwise("xor", self, o)  # noqa: E704
    def __invert__(self): return logical_not(self) if self.type.is_bool else bitwise("xor", self, const(self.type.max if self.type.is_uint else -1, self.type))  # noqa: E704
    def __lshift__(self, o): return shift(self, o, left=True)  # noqa: E704
    def __rshift__(self, o): return shift(self, o, left=False)  # noqa: E704


def const(value, type: ElementType | None = None) -> Expr:
    return Expr(type or literal_type(value), value=value)


def col(name: str, type: ElementType) -> Expr:
    """An existing column that holds values of an element type."""
    return Expr(type, name=name)


def node(type: ElementType, build: Callable, *args: Expr, tag: str | None = None) -> Expr:
    return Expr(type, args, build, tag=tag)


def matched(a, b) -> tuple[Expr, Expr]:
    """Both operands in their common type; a literal takes the other's and must fit it."""
    if not isinstance(a, Expr) and not isinstance(b, Expr):
        return const(a), const(b)
    if not isinstance(a, Expr):
        b, a = matched(b, a)
        return a, b
    if not isinstance(b, Expr):
        if a.type.is_float:
            return a, const(float(b), a.type)
        if isinstance(b, float):
            return cast(F32, a), const(b, F32)
        if isinstance(b, bool) and not a.type.is_bool:
            b = int(b)
        if not a.type.can_hold(b):
            raise TypeError(f"{b} does not fit {a.type}")
        return a, const(bool(b) if a.type.is_bool else b, a.type)
    t = common_type(a.type, b.type)
    return cast(t, a), cast(t, b)


def cast(type: ElementType, e) -> Expr:
    e = e if isinstance(e, Expr) else const(e, type if type.can_hold(e) and (type.is_float or not isinstance(e, float)) else None)
    if e.type == type:
        return e
    if e.value is not None and not e.type.is_float and type.can_hold(e.value):
        return const(float(e.value) if type.is_float else bool(e.value) if type.is_bool else int(e.value), type)
    return node(type, lambda c: convert(c, e.type, type), e, tag=f"cast:{type}")


def saturating_cast(type: ElementType, e: Expr) -> Expr:
    return node(type, lambda c: convert(c, e.type, type, saturate=True), e, tag=f"saturating_cast:{type}")


def reinterpret(type: ElementType, e: Expr) -> Expr:
    """Same bits in another integer type of equal width."""
    if type.bits != e.type.bits or type.is_float or e.type.is_float:
        raise TypeError("only integers of equal width have their bits reinterpreted")
    return cast(type, e)


def lossless_cast(type: ElementType, e: Expr) -> Expr | None:
    """The expression in another type if every value of its own (or its bounds, where a
    widening, a mask or a constant gives them) fits; else None."""
    if e.type == type:
        return e
    if type.is_float:
        exact = {32: 24, 64: 53}.get(type.bits, 11)
        return cast(type, e) if e.type.is_float and e.type.bits <= type.bits or not e.type.is_float and e.type.bits <= exact else None
    if e.type.is_float:
        return None
    lo, hi = _bounds(e)
    return cast(type, e) if type.min <= lo and hi <= type.max else None


def _bounds(e: Expr) -> tuple[int, int]:
    if e.value is not None:
        return int(e.value), int(e.value)
    if (e.tag or "").startswith("cast:") and not e.args[0].type.is_float:
        lo, hi = _bounds(e.args[0])
        if e.type.min <= lo and hi <= e.type.max:
            return lo, hi
    if e.tag == "bitand" and e.args[1].value is not None and e.args[1].value >= 0:
        return 0, int(e.args[1].value)
    if e.tag in ("min", "max"):
        (a, b), (c, d) = map(_bounds, e.args)
        pick = min if e.tag == "min" else max
        return pick(a, c), pick(b, d)
    return e.type.min, e.type.max


def fast_integer_divide(a: Expr, b: Expr) -> Expr:
    """Quotient by an unsigned 8-bit number of 1 to 255, rounded down, in a's type."""
    if b.type != UInt(8) or a.type.is_float or a.type.bits > 32:
        raise TypeError("integers of up to 32 bits are divided by unsigned 8-bit numbers")
    return node(a.type, lambda x, y: F.floor(x.cast("bigint") / F.when(y == 0, F.lit(1)).otherwise(y)).cast(a.type.spark), a, b, tag="fast_div")


def fast_integer_modulo(a: Expr, b: Expr) -> Expr:
    return cast(a.type, a - fast_integer_divide(a, b) * cast(a.type, b))


def _wide(c: Column, t: ElementType) -> Column:
    return c.cast(t.wide)


def _safe(b: Column) -> Column:
    return F.when(b == 0, F.lit(1).cast("bigint")).otherwise(b)


def euclid_mod(a: Column, b: Column) -> Column:
    """0 <= result < |b|; 0 for b = 0.  Whole-number columns."""
    return F.when(b == 0, F.lit(0)).otherwise(F.pmod(a, F.abs(_safe(b))))


def euclid_div(a: Column, b: Column) -> Column:
    """(a - euclid_mod(a, b)) / b; 0 for b = 0.  Columns of bigint."""
    rest = a - F.pmod(a, F.abs(_safe(b)))
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", rest, _safe(b)))


def _float_div(a: Column, b: Column) -> Column:
    """IEEE division by zero, whatever the ANSI setting."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def arith(kind: str, a, b) -> Expr:
    a, b = matched(a, b)
    t = a.type
    if t.is_bool:
        raise TypeError("no arithmetic on booleans")
    if t.is_float:
        ops = {
            "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": _float_div,
            "mod": lambda x, y: x - y * F.floor(_float_div(x, y)),
        }
        return node(t, lambda x, y: ops[kind](x, y).cast(t.spark), a, b, tag=kind)
    if kind in ("add", "sub", "mul"):
        ops = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}
        if t.bits == 32 and t.is_uint and kind == "mul":
            return node(t, mul_u32, a, b, tag=kind)
        if t.bits == 64 and t.is_int:  # decimals only where a sum leaves 64 bits
            out = node(t, lambda x, y: wrap(ops[kind](_wide(x, t), _wide(y, t)), t), a, b, tag=kind)
            out.quick = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[kind]
            return out
        return node(t, lambda x, y: wrap(ops[kind](_wide(x, t), _wide(y, t)), t), a, b, tag=kind)
    if t.bits == 64 and t.is_uint:
        raise TypeError("uint64 division is not supported")
    ops = {"div": euclid_div, "mod": euclid_mod}
    if t.bits == 64:  # within 64 bits: the least number by -1 stays itself
        over = lambda x, y: (x == F.lit(t.min)) & (y == -1)
        return node(t, lambda x, y: F.when(over(x, y), x if kind == "div" else F.lit(0).cast("bigint")).otherwise(ops[kind](x, y)), a, b, tag=kind)
    return node(t, lambda x, y: wrap(ops[kind](x.cast("bigint"), y.cast("bigint")), t), a, b, tag=kind)


def mul_u32(a: Column, b: Column) -> Column:
    """Product of two uint32 in bigint columns, modulo 2^32, without leaving 64 bits."""
    a, b = a.cast("bigint"), b.cast("bigint")
    high = F.shiftright(a, 16) * b
    low = a.bitwiseAND(0xFFFF) * b
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + low).bitwiseAND(0xFFFFFFFF)


_COMPARE = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}


def compare(kind: str, a, b) -> Expr:
    a, b = matched(a, b)
    ops = {"lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y}
    return node(Bool, ops[kind], a, b, tag=kind)


def _bool(e) -> Expr:
    return cast(Bool, e) if isinstance(e, Expr) else const(bool(e))


def logical_and(*args) -> Expr:
    return reduce(lambda a, b: node(Bool, lambda x, y: x & y, a, b, tag="and"), map(_bool, args))


def logical_or(*args) -> Expr:
    return reduce(lambda a, b: node(Bool, lambda x, y: x | y, a, b, tag="or"), map(_bool, args))


def logical_not(a) -> Expr:
    return node(Bool, lambda x: ~x, _bool(a), tag="not")


def _fold2(kind: str, f: Callable, args) -> Expr:
    def two(a, b):
        a, b = matched(a, b)
        return node(a.type, f, a, b, tag=kind)

    return reduce(two, args)


def max_(*args) -> Expr:
    return _fold2("max", F.greatest, args)


def min_(*args) -> Expr:
    return _fold2("min", F.least, args)


def clamp(a: Expr, lo, hi) -> Expr:
    """max(min(a, hi), lo), with the bounds in a's type."""
    return max_(min_(a, cast(a.type, hi)), cast(a.type, lo))


def abs_(a: Expr) -> Expr:
    """Signed integers give the unsigned type of their width."""
    if a.type.is_uint:
        return a
    t = UInt(a.type.bits) if a.type.is_int else a.type
    return node(t, lambda x: F.abs(_wide(x, a.type) if a.type.is_int else x).cast(t.spark), a, tag="abs")


def absd(a, b) -> Expr:
    """Distance, unsigned for integers."""
    a, b = matched(a, b)
    t = a.type if a.type.is_float else UInt(a.type.bits)
    return node(t, lambda x, y: F.abs(_wide(x, a.type) - _wide(y, a.type) if not t.is_float else x - y).cast(t.spark), a, b, tag="absd")


def select(*args):
    """select(c0, v0, c1, v1, ..., default): the first true condition's value.  Tuples of
    values give tuples."""
    if any(isinstance(a, tuple) for a in args):
        n = next(len(a) for a in args if isinstance(a, tuple))
        return tuple(select(*[a[i] if isinstance(a, tuple) else a for a in args]) for i in range(n))
    if len(args) == 1:
        return args[0]
    cond, then = args[0], args[1]
    other = select(*args[2:])
    then, other = matched(then, other)
    return node(then.type, lambda c, x, y: F.when(c, x).otherwise(y), _bool(cond), then, other, tag="select")


def mux(i: Expr, values: list):
    """The i-th value (or tuple); the last for an index out of range."""
    return select(*[x for k, v in enumerate(values[:-1]) for x in (i == k, v)], values[-1])


def bitwise(kind: str, a, b) -> Expr:
    a, b = matched(a, b)
    if a.type.is_float:
        raise TypeError("no bit operations on floats")
    if a.type.is_bool:
        return {"and": logical_and, "or": logical_or, "xor": lambda x, y: x != y}[kind](a, b)
    if a.type.bits == 64 and a.type.is_uint:
        raise TypeError("uint64 bit operations are not supported")
    ops = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}
    return node(a.type, lambda x, y: ops[kind](x.cast("bigint"), y.cast("bigint")).cast(a.type.spark), a, b, tag=f"bit{kind}")


def shift(a: Expr, b, left: bool) -> Expr:
    """By a negative count the other way; arithmetic to the right for signed types."""
    b = b if isinstance(b, Expr) else const(b, I32)

    def build(x, y):
        x, n = x.cast("bigint"), (y if left else -y).cast("int")
        up, down = F.greatest(F.least(n, F.lit(63)), F.lit(0)), F.greatest(F.least(-n, F.lit(63)), F.lit(0))
        return wrap(F.when(n >= 0, F.call_function("shiftleft", x, up)).otherwise(F.call_function("shiftright", x, down)), a.type)

    return node(a.type, build, a, b, tag="shl" if left else "shr")


def _masked(x: Column, t: ElementType) -> Column:
    return x.cast("bigint") if t.bits == 64 else F.pmod(x.cast("bigint"), F.lit(1 << t.bits))


def popcount(a: Expr) -> Expr:
    return node(a.type, lambda x: F.bit_count(_masked(x, a.type)).cast(a.type.spark), a)


def count_leading_zeros(a: Expr) -> Expr:
    n = a.type.bits
    return node(a.type, lambda x: F.when(x == 0, F.lit(n)).otherwise(n - F.length(F.bin(_masked(x, a.type)))).cast(a.type.spark), a)


def count_trailing_zeros(a: Expr) -> Expr:
    n = a.type.bits
    return node(a.type, lambda x: F.when(x == 0, F.lit(n)).otherwise(F.bit_count(_masked(x, a.type).bitwiseAND(-_masked(x, a.type)) - 1)).cast(a.type.spark), a)


def extract_bits(type: ElementType, a: Expr, lsb) -> Expr:
    """Bits from ``lsb`` on, zeros above the top."""
    return cast(type, shift(cast(UInt(a.type.bits), a), lsb, left=False))


def concat_bits(parts: list[Expr]) -> Expr:
    """Bits of all parts, the first lowest; a power of two of them."""
    n, w = len(parts), parts[0].type.bits
    if n & n - 1 or n * w > 32:
        raise TypeError("a power of two of parts, up to 32 bits in all")
    return node(UInt(n * w), lambda *cs: reduce(lambda x, y: x + y, [F.shiftleft(_masked(c, parts[0].type), i * w) for i, c in enumerate(cs)]).cast(UInt(n * w).spark), *parts)


# -- fixed point ------------------------------------------------------------------


def _exact(t: ElementType, f: Callable, *args: Expr, saturate: bool = False) -> Expr:
    """f on exact wide values, then brought to t."""
    wide = "decimal(38,0)" if max(a.type.bits for a in args) > 32 else "bigint"
    return node(t, lambda *cs: (clamp_to if saturate else wrap)(f(*[c.cast(wide) for c in cs]), t), *args)


def div_round_to_zero(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: F.call_function("div", x, F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(y)), a, b)


def mod_round_to_zero(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: x % F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(y), a, b)


def widening_add(a: Expr, b: Expr) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type.widened(), lambda x, y: x + y, a, b)


def widening_sub(a: Expr, b: Expr) -> Expr:
    a, b = matched(a, b)
    return _exact(Int(a.type.bits * 2), lambda x, y: x - y, a, b)


def widening_mul(a: Expr, b: Expr) -> Expr:
    code = "int" if "int" in (a.type.code, b.type.code) else "uint"
    return _exact(ElementType(code, 2 * max(a.type.bits, b.type.bits)), lambda x, y: x * y, a, b)


def widen_right_add(a: Expr, b: Expr) -> Expr:
    return a + cast(b.type.widened(), b)


def widen_right_sub(a: Expr, b: Expr) -> Expr:
    return a - cast(b.type.widened(), b)


def widen_right_mul(a: Expr, b: Expr) -> Expr:
    return a * cast(b.type.widened(), b)


def widening_shift_left(a: Expr, b) -> Expr:
    return shift(cast(a.type.widened(), a), b, left=True)


def widening_shift_right(a: Expr, b) -> Expr:
    return shift(cast(a.type.widened(), a), b, left=False)


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.least(n.cast("int"), F.lit(62)), F.lit(0)))


def _down(x: Column, n: Column, half: bool) -> Column:
    """floor((x + half) / 2^n) for n >= 0."""
    n = F.greatest(n.cast("int"), F.lit(0))
    up = F.when(n > 0, _power(n - 1)).otherwise(F.lit(0).cast("bigint")) if half else F.lit(0).cast("bigint")
    return F.call_function("shiftright", x + up, n)


def rounding_shift_right(a: Expr, b) -> Expr:
    b = b if isinstance(b, Expr) else const(b, I32)
    return _exact(a.type, lambda x, n: F.when(n >= 0, _down(x, n, True)).otherwise(x * _power(-n)), a, b, saturate=True)


def rounding_shift_left(a: Expr, b) -> Expr:
    return rounding_shift_right(a, -(b if isinstance(b, Expr) else const(b, I32)))


def saturating_add(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: x + y, a, b, saturate=True)


def saturating_sub(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: x - y, a, b, saturate=True)


def halving_add(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: F.shiftright(x + y, 1), a, b)


def rounding_halving_add(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: F.shiftright(x + y + 1, 1), a, b)


def halving_sub(a, b) -> Expr:
    a, b = matched(a, b)
    return _exact(a.type, lambda x, y: F.shiftright(x - y, 1), a, b)


def mul_shift_right(a, b, q) -> Expr:
    a, b = matched(a, b)
    q = q if isinstance(q, Expr) else const(q, I32)
    return _exact(a.type, lambda x, y, n: _down(x * y, n, False), a, b, q, saturate=True)


def rounding_mul_shift_right(a, b, q) -> Expr:
    a, b = matched(a, b)
    q = q if isinstance(q, Expr) else const(q, I32)
    return _exact(a.type, lambda x, y, n: _down(x * y, n, True), a, b, q, saturate=True)


# -- floats -----------------------------------------------------------------------


def _math(f: Callable[[Column], Column], name: str | None = None) -> Callable[[Expr], Expr]:
    tag = f"math:{name or f.__name__}"

    def make(a) -> Expr:
        a = a if isinstance(a, Expr) else const(float(a))
        a = a if a.type.is_float else cast(F32, a)
        return node(a.type, lambda x: f(x).cast(a.type.spark), a, tag=tag)

    return make


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(F.when(x > 0, x).otherwise(F.when(F.isnan(x), x).otherwise(F.lit(1.0)))))


def _trunc(x: Column) -> Column:
    small = F.abs(x) < float(1 << 52)  # beyond, and for nan, a float is whole already
    y = F.when(small, x).otherwise(F.lit(0.0))
    return F.when(small, F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("double")).otherwise(x)


def _whole(f: Callable) -> Callable[[Column], Column]:
    def build(x: Column) -> Column:
        small = F.abs(x) < float(1 << 52)
        return F.when(small, f(F.when(small, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)

    return build


def _erf(x: Column) -> Column:
    """Rational approximation 7.1.26 of Abramowitz and Stegun, error below 1.5e-7."""
    a, t = F.abs(x), 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


sin, cos, tan = _math(F.sin), _math(F.cos), _math(F.tan)
asin, acos, atan = _math(F.asin), _math(F.acos), _math(F.atan)
sinh, cosh, tanh = _math(F.sinh), _math(F.cosh), _math(F.tanh)
asinh, acosh, atanh = _math(F.asinh), _math(F.acosh), _math(F.atanh)
sqrt, exp, log, erf = _math(F.sqrt), _math(F.exp), _math(_log, "log"), _math(_erf, "erf")
fast_sin, fast_cos, fast_exp, fast_log = sin, cos, exp, log
fast_inverse = _math(lambda x: _float_div(F.lit(1.0), x), "inverse")
fast_inverse_sqrt = _math(lambda x: _float_div(F.lit(1.0), F.sqrt(x)), "inverse_sqrt")
floor, ceil, trunc = _math(_whole(F.floor), "floor"), _math(_whole(F.ceil), "ceil"), _math(_trunc, "trunc")
round_ = _math(F.rint)
fract = _math(lambda x: x - _trunc(x), "fract")


def atan2(y, x) -> Expr:
    y, x = matched(y, x)
    y, x = (e if e.type.is_float else cast(F32, e) for e in (y, x))
    return node(y.type, lambda a, b: F.atan2(a, b).cast(y.type.spark), y, x, tag="atan2")


def hypot(x, y) -> Expr:
    return sqrt(x * x + y * y)


def pow_(x: Expr, y) -> Expr:
    """A constant whole exponent multiplies; integers stay integers."""
    if isinstance(y, int) and not isinstance(y, bool):
        if y < 0:
            return const(1.0, x.type if x.type.is_float else F32) / pow_(x if x.type.is_float else cast(F32, x), -y)
        out, base = None, x
        while y:
            if y & 1:
                out = base if out is None else out * base
            base, y = base * base, y >> 1
        return out if out is not None else const(1.0 if x.type.is_float else 1, x.type)
    x, y = matched(x, y)
    x, y = (e if e.type.is_float else cast(F32, e) for e in (x, y))
    return node(x.type, lambda a, b: F.pow(a, b).cast(x.type.spark), x, y, tag="pow")


fast_pow = pow_


def fma(a, b, c) -> Expr:
    return a * b + c


def _test(f: Callable[[Column], Column]) -> Callable[[Expr], Expr]:
    def make(a: Expr) -> Expr:
        if not a.type.is_float:
            raise TypeError("a float is tested")
        return node(Bool, f, a)

    return make


is_nan = _test(F.isnan)
is_inf = _test(lambda x: F.abs(x) == float("inf"))
is_finite = _test(lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def lerp(zero: Expr, one: Expr, weight) -> Expr:
    """zero * (1 - w) + one * w.  An unsigned weight of n bits stands for w / (2^n - 1);
    integers are rounded exactly; a bool weight (or ends) picks."""
    zero, one = matched(zero, one)
    t = zero.type
    if t.bits == 64 and not t.is_float:
        raise TypeError("no lerp of 64-bit integers")
    if not isinstance(weight, Expr):
        if not t.is_float and not 0 <= weight <= 1:
            raise ValueError("a constant weight for integers lies in 0..1")
        weight = const(float(weight), F32 if not t.is_float else t)
    w = weight
    if t.is_bool:
        limit = 0.5 if w.type.is_float else (w.type.max + 1) // 2
        return select(w >= limit if not w.type.is_float else w > limit, one, zero)
    if t.is_float:
        w = w if w.type.is_float else cast(t, w) / float(w.type.max)
        return zero * (1.0 - w) + one * w
    if w.type.is_float:
        return node(t, lambda z, o, k: clamp_to(F.floor(z.cast("double") * (1 - k.cast("double")) + o.cast("double") * k.cast("double") + 0.5).cast("bigint"), t), zero, one, w)
    top = w.type.max
    kind = "bigint" if t.bits + w.type.bits <= 48 else "decimal(38,0)"
    low = t.min  # signed ends are shifted to start at zero, so that rounding goes one way

    def build(z, o, k):
        z, o, k = z.cast(kind) - low, o.cast(kind) - low, k.cast(kind)
        return (F.call_function("div", z * (top - k) + o * k + top // 2, F.lit(top).cast(kind)) + low).cast(t.spark)

    return node(t, build, zero, one, w)


# -- random numbers: a hash of the coordinates, a tag and a seed --------------------

#: Coefficients of the quadratic step modulo 2^32 (fixed values, so that streams repeat).
RNG_COEFFICIENTS = (576942909, 1121052041, 1040796640)


def rng32(x: Column) -> Column:
    c0, c1, c2 = RNG_COEFFICIENTS
    y = (mul_u32(F.lit(c2).cast("bigint"), x) + c1).bitwiseAND(0xFFFFFFFF)
    return (mul_u32(y, x) + c0).bitwiseAND(0xFFFFFFFF)


def random_uint(coords: list[Expr], seed: int = 0, tag: int = 0) -> Expr:
    """uint32, the same for the same coordinates, seed and tag."""

    def build(*cs):
        r = rng32(F.lit(seed & 0xFFFFFFFF).cast("bigint"))
        for c in (*reversed(cs), F.lit(tag)):
            r = rng32((r + F.pmod(c.cast("bigint"), F.lit(1 << 32))).bitwiseAND(0xFFFFFFFF))
        return r.bitwiseXOR(F.shiftright(r, 16))

    return node(U32, build, *coords)


def random_int(coords: list[Expr], seed: int = 0, tag: int = 0) -> Expr:
    return cast(I32, random_uint(coords, seed, tag))


def random_float(coords: list[Expr], seed: int = 0, tag: int = 0) -> Expr:
    """[0, 1) with 23 random bits."""
    u = random_uint(coords, seed, tag)
    return node(F32, lambda r: (F.shiftright(r, 9).cast("double") / (1 << 23)).cast("float"), u)


# -- checks and hints --------------------------------------------------------------


def require(cond, e: Expr, message: str = "requirement failed") -> Expr:
    return node(e.type, lambda c, x: F.when(c, x).otherwise(F.raise_error(F.lit(message)).cast(e.type.spark)), _bool(cond), e)


def likely(e: Expr) -> Expr:
    return e


likely_if_innermost = strict_float = likely  # float operations are never reordered in a plan


def unsafe_promise_clamped(e: Expr, lo, hi) -> Expr:
    """The value, of which the planner believes that it lies between the bounds."""
    return node(e.type, lambda x, *_: x, e, cast(e.type, lo), cast(e.type, hi), tag="promise")


def promise_clamped(e: Expr, lo, hi) -> Expr:
    """As ``unsafe_promise_clamped``, but checked at each point."""
    return node(e.type, lambda x, a, b: F.when((x >= a) & (x <= b), x).otherwise(F.raise_error(F.lit("a promise was broken")).cast(e.type.spark)), e, cast(e.type, lo), cast(e.type, hi), tag="promise")


def print_(e: Expr, *_) -> Expr:
    """Values of a plan are looked at by its result; the expression stays as it is."""
    return e


def print_when(cond, e: Expr, *_) -> Expr:
    return e


def unreachable(type: ElementType = I32) -> Expr:
    """A value that must never be asked for."""
    return node(type, lambda: F.raise_error(F.lit("unreachable code was reached")).cast(type.spark))


def memoize_tag(e: Expr, *_) -> Expr:
    return e


class Undef:
    """A store that does not happen."""


def undef(type: ElementType) -> Undef:
    return Undef()


class Lanes:
    """Several places or values of one store: ``gather`` reads them all before the store
    of ``scatter`` writes any."""

    def __init__(self, items: list):
        if len(items) < 2:
            raise TypeError("two lanes or more")
        self.items = items


def scatter(*places) -> Lanes:
    return Lanes(list(places))


def gather(*values) -> Lanes:
    return Lanes(list(values))


def target_arch_is(_: str) -> bool:
    """Plans run on a virtual machine."""
    return False


target_os_is = target_arch_is


def target_bits() -> int:
    return 64


def target_has_feature(_: str) -> bool:
    return False


def target_natural_vector_size(_: ElementType) -> int:
    return 1


def _short(t: ElementType, saturate: bool = False) -> Callable[[Expr], Expr]:
    return (lambda e: saturating_cast(t, e)) if saturate else (lambda e: cast(t, e))


f64, f32, f16 = _short(Float(64)), _short(Float(32)), _short(Float(16))
i64, i32, i16, i8 = (_short(Int(b)) for b in (64, 32, 16, 8))
u64, u32, u16, u8 = (_short(UInt(b)) for b in (64, 32, 16, 8))
i64_sat, i32_sat, i16_sat, i8_sat = (_short(Int(b), True) for b in (64, 32, 16, 8))
u64_sat, u32_sat, u16_sat, u8_sat = (_short(UInt(b), True) for b in (64, 32, 16, 8))

