"""Element types with fixed widths, their coercions, and wrapping arithmetic on columns.

A value lives in the narrowest Spark type that holds its range: unsigned types in the
next wider signed one, uint64 in decimal(20,0).  Arithmetic is done wide and then
brought back by ``wrap`` or ``saturate``, so nothing depends on the ANSI setting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ElementType:
    code: str  # int, uint, float or bfloat
    bits: int

    @property
    def is_float(self) -> bool:
        return self.code in ("float", "bfloat")

    @property
    def is_int(self) -> bool:
        return self.code == "int"

    @property
    def is_uint(self) -> bool:
        return self.code == "uint"

    @property
    def is_bool(self) -> bool:
        return self.code == "uint" and self.bits == 1

    @property
    def min(self):
        """Least value; minus infinity for floats."""
        return float("-inf") if self.is_float else (-(1 << self.bits - 1) if self.is_int else 0)

    @property
    def max(self):
        return float("inf") if self.is_float else ((1 << self.bits - self.is_int) - 1)

    @property
    def spark(self) -> str:
        if self.is_bool:
            return "boolean"
        if self.is_float:
            return "double" if self.bits == 64 else "float"
        signed = self.bits + self.is_uint
        return next(name for width, name in ((8, "tinyint"), (16, "smallint"), (32, "int"), (64, "bigint"), (128, "decimal(20,0)")) if signed <= width)

    @property
    def wide(self) -> str:
        """Where products and sums of two values are exact."""
        return "bigint" if self.bits <= 16 or (self.bits == 32 and self.is_int) else "decimal(38,0)"

    def widened(self) -> "ElementType":
        return ElementType(self.code, self.bits * 2)

    def can_hold(self, value) -> bool:
        return self.is_float or self.min <= value <= self.max

    def __str__(self) -> str:
        return f"{self.code}{self.bits}"


def Int(bits: int) -> ElementType:
    return ElementType("int", bits)


def UInt(bits: int) -> ElementType:
    return ElementType("uint", bits)


def Float(bits: int) -> ElementType:
    return ElementType("float", bits)


def BFloat(bits: int = 16) -> ElementType:
    return ElementType("bfloat", bits)


Bool = UInt(1)
I8, I16, I32, I64 = Int(8), Int(16), Int(32), Int(64)
U8, U16, U32, U64 = UInt(8), UInt(16), UInt(32), UInt(64)
F16, F32, F64 = Float(16), Float(32), Float(64)


def common_type(a: ElementType, b: ElementType) -> ElementType:
    """Type that both operands of an arithmetic operator take: a float meets an integer
    in the float's own type; of equal kinds the wider; of mixed signs the signed one of
    the greater width."""
    if a == b:
        return a
    if a.is_float or b.is_float:
        if a.is_float and b.is_float:
            return a if a.bits >= b.bits else b
        return a if a.is_float else b
    if a.code == b.code:
        return a if a.bits >= b.bits else b
    return Int(max(a.bits, b.bits))


def literal_type(value) -> ElementType:
    if isinstance(value, bool):
        return Bool
    return I32 if isinstance(value, int) else F32


def wrap(value: Column, to: ElementType) -> Column:
    """An exact whole number modulo 2^bits, in the type's range and storage."""
    if to.bits == 64:
        wide = value.cast("decimal(38,0)")
        span = F.lit(str(1 << 64)).cast("decimal(38,0)")
        half = F.lit(str(1 << 63)).cast("decimal(38,0)") if to.is_int else F.lit(0).cast("decimal(38,0)")
        return (F.pmod(wide + half, span) - half).cast(to.spark)
    if to.is_int:
        half = 1 << to.bits - 1
        return (F.pmod(value + F.lit(half), F.lit(1 << to.bits)) - F.lit(half)).cast(to.spark)
    return F.pmod(value, F.lit(1 << to.bits)).cast(to.spark)


def clamp_to(value: Column, to: ElementType) -> Column:
    if to.is_float:
        return value.cast(to.spark)
    lo, hi = to.min, to.max
    if to.bits == 64:
        lo, hi = (F.lit(str(x)).cast("decimal(38,0)") for x in (lo, hi))
    else:
        lo, hi = F.lit(lo), F.lit(hi)
    return F.greatest(F.least(value, hi), lo).cast(to.spark)


def convert(value: Column, frm: ElementType, to: ElementType, saturate: bool = False) -> Column:
    """Cast: integers wrap (or saturate), floats go toward zero, bool becomes 0 or 1.
    Floats of 16 bits are kept in 32-bit storage."""
    if frm == to:
        return value
    if frm.is_bool:
        return value.cast("int").cast(to.spark)
    if to.is_bool:
        return value != F.lit(0).cast(frm.spark)
    if to.is_float:
        return value.cast(to.spark)
    if frm.is_float:
        # inside +-2^62 the double is exact enough to be made a long; outside it clamps
        d = F.when(F.isnan(value), F.lit(0.0)).otherwise(value.cast("double"))
        if saturate:
            d = F.greatest(F.least(d, F.lit(float(min(to.max, (1 << 62))))), F.lit(float(max(to.min, -(1 << 62)))))
        whole = F.greatest(F.least(d, F.lit(float(1 << 62))), F.lit(float(-(1 << 62)))).cast("bigint")
        return clamp_to(whole, to) if saturate else wrap(whole, to)
    wide = value.cast("decimal(38,0)" if 64 in (frm.bits, to.bits) else "bigint")
    if frm.min >= to.min and frm.max <= to.max:
        return value.cast(to.spark)
    return clamp_to(wide, to) if saturate else wrap(wide, to)
