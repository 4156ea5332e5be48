"""Boxes of integer coordinates and the box that an index expression can reach."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.expr import Expr


@dataclass(frozen=True)
class Range:
    min: int
    extent: int

    @property
    def max(self) -> int:
        return self.min + self.extent - 1

    def union(self, o: "Range") -> "Range":
        lo = min(self.min, o.min)
        return Range(lo, max(self.max, o.max) - lo + 1)

    def contains(self, o: "Range") -> bool:
        return self.min <= o.min and o.max <= self.max


Box = tuple[Range, ...]


def box(*pairs) -> Box:
    """From extents (minimum 0) or (min, extent) pairs."""
    return tuple(Range(0, p) if isinstance(p, int) else p if isinstance(p, Range) else Range(*p) for p in pairs)


def union(a: Box | None, b: Box) -> Box:
    return b if a is None else tuple(x.union(y) for x, y in zip(a, b))


class Unbounded(ValueError):
    """No finite bound follows from the expression."""


def interval(e: Expr, env: dict[str, Range]) -> tuple[int, int]:
    """Least and greatest value of an integer expression over the variables' ranges.

    Sums, differences, products, Euclidean quotients and remainders by constants, minima,
    maxima, selections and integer casts are followed; anything else is unbounded."""
    if e.value is not None:
        return int(e.value), int(e.value)
    if e.name is not None:
        if e.name not in env:
            raise Unbounded(e.name)
        return env[e.name].min, env[e.name].max
    tag = e.tag or ""
    if tag == "mod":
        lo, hi = interval(e.args[1], env)
        if lo == hi and lo != 0:
            try:
                a, b = interval(e.args[0], env)
                if a // abs(lo) == b // abs(lo):
                    return a % abs(lo), b % abs(lo)
            except Unbounded:
                pass
            return 0, abs(lo) - 1
        raise Unbounded("mod")
    if tag in ("max", "min"):
        bounds = []
        for a in e.args:
            try:
                bounds.append(interval(a, env))
            except Unbounded:
                bounds.append(None)
        pick = max if tag == "max" else min
        if None not in bounds:
            return pick(bounds[0][0], bounds[1][0]), pick(bounds[0][1], bounds[1][1])
        # clamp(anything, lo, hi): the outer max of a half-bounded min
        half = [b for b in bounds if b is not None]
        if half and tag == "min":
            raise HalfBounded(hi=half[0][1])
        inner = next(a for a, b in zip(e.args, bounds) if b is None)
        try:
            interval(inner, env)
        except HalfBounded as h:
            if half:
                return half[0][0], max(h.hi, half[0][1])
        raise Unbounded(tag)
    if tag == "promise":
        return interval(e.args[1], env)[0], interval(e.args[2], env)[1]
    if tag == "select":
        a, b = interval(e.args[1], env), interval(e.args[2], env)
        return min(a[0], b[0]), max(a[1], b[1])
    if tag.startswith(("cast:", "saturating_cast:")):
        bits = e.type
        try:
            lo, hi = interval(e.args[0], env)
            if bits.min <= lo and hi <= bits.max:
                return lo, hi
        except Unbounded:
            pass
        if not bits.is_float and bits.bits <= 16:
            return bits.min, bits.max
        raise Unbounded(tag)
    if tag in ("add", "sub", "mul", "div"):
        (a, b), (c, d) = interval(e.args[0], env), interval(e.args[1], env)
        if tag == "add":
            return a + c, b + d
        if tag == "sub":
            return a - d, b - c
        if tag == "mul":
            ends = [x * y for x in (a, b) for y in (c, d)]
            return min(ends), max(ends)
        if c == d and c != 0:
            ends = [(x - x % abs(c)) // c for x in (a, b)]
            return min(ends), max(ends)
    if not e.type.is_float and e.type.bits <= 16 and e.call is not None:
        return e.type.min, e.type.max
    raise Unbounded(tag or "expression")


class HalfBounded(Unbounded):
    def __init__(self, hi: int):
        super().__init__("half bounded")
        self.hi = hi


def shift_of(e: Expr) -> tuple[str, int] | None:
    """(variable, constant) if the expression is variable + constant."""
    if e.name is not None:
        return e.name, 0
    if e.tag in ("add", "sub") and e.args[1].value is not None:
        inner = shift_of(e.args[0])
        if inner:
            return inner[0], inner[1] + (1 if e.tag == "add" else -1) * int(e.args[1].value)
    if e.tag == "add" and e.args[0].value is not None:
        inner = shift_of(e.args[1])
        if inner:
            return inner[0], inner[1] + int(e.args[0].value)
    return None
