"""Arrays as tables: integer coordinate columns, value columns and a region."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import F64, I32, ElementType
from ..plans.region import Box, Range, box


def domain(spark: SparkSession, dims: list[str], region: Box) -> DataFrame:
    """All points of a box, one row each, from one generated range: coordinates are
    digits of the row number, so no cross join is needed."""
    total = reduce(lambda a, r: a * max(r.extent, 0), region, 1)
    cols, step = [], 1
    for d, r in zip(dims, region):
        n = max(r.extent, 1)
        cols.append((F.pmod(F.call_function("div", F.col("id"), F.lit(step).cast("bigint")), F.lit(n)) + r.min).cast("int").alias(d))
        step *= n
    return spark.range(total).select(*cols) if dims else spark.range(1).select()


@dataclass(frozen=True)
class ArrayTable:
    """``dims`` and ``values`` name columns of ``df``; ``region`` may be None (unknown)."""

    df: DataFrame
    dims: tuple[str, ...]
    values: tuple[str, ...] = ("v",)
    types: tuple[ElementType, ...] = (F64,)
    region: Box | None = None

    def __post_init__(self):
        missing = set(self.dims + self.values) - set(self.df.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        if self.region is not None and len(self.region) != len(self.dims):
            raise ValueError("the region has a range for each dimension")

    def _at(self, d: int | str) -> int:
        return self.dims.index(d) if isinstance(d, str) else d

    def _with(self, df: DataFrame, **changes) -> "ArrayTable":
        return replace(self, df=df, **changes)

    # shape -------------------------------------------------------------------
    def crop(self, d, min: int, extent: int) -> "ArrayTable":
        i = self._at(d)
        r = None if self.region is None else (*self.region[:i], Range(min, extent), *self.region[i + 1 :])
        return self._with(self.df.where(F.col(self.dims[i]).between(min, min + extent - 1)), region=r)

    def translate(self, d, by: int) -> "ArrayTable":
        i = self._at(d)
        r = None if self.region is None else (*self.region[:i], Range(self.region[i].min + by, self.region[i].extent), *self.region[i + 1 :])
        return self._with(self.df.withColumn(self.dims[i], (F.col(self.dims[i]) + by).cast("int")), region=r)

    def set_min(self, *mins: int) -> "ArrayTable":
        out = self
        for i, m in enumerate(mins):
            out = out.translate(i, m - self.region[i].min)
        return out

    def transpose(self, d1=0, d2=1) -> "ArrayTable":
        order = list(range(len(self.dims)))
        i, j = self._at(d1), self._at(d2)
        order[i], order[j] = j, i
        return self.permute(order)

    def permute(self, order: list[int]) -> "ArrayTable":
        """Dimension k of the result is dimension order[k]; names stay in place."""
        moved = [F.col(self.dims[o]).alias(self.dims[k]) for k, o in enumerate(order)]
        r = None if self.region is None else tuple(self.region[o] for o in order)
        return self._with(self.df.select(*moved, *self.values), region=r)

    def reverse_axes(self) -> "ArrayTable":
        return self.permute(list(range(len(self.dims)))[::-1])

    def slice(self, d, pos: int) -> "ArrayTable":
        i = self._at(d)
        r = None if self.region is None else self.region[:i] + self.region[i + 1 :]
        return self._with(self.df.where(F.col(self.dims[i]) == pos).drop(self.dims[i]), dims=self.dims[:i] + self.dims[i + 1 :], region=r)

    def embed(self, name: str, at: int, pos: int = 0) -> "ArrayTable":
        r = None if self.region is None else (*self.region[:at], Range(pos, 1), *self.region[at:])
        return self._with(self.df.withColumn(name, F.lit(pos).cast("int")), dims=(*self.dims[:at], name, *self.dims[at:]), region=r)

    def add_dimension(self, name: str) -> "ArrayTable":
        return self.embed(name, len(self.dims))

    # content -----------------------------------------------------------------
    def map(self, **exprs: Column) -> "ArrayTable":
        return self._with(self.df.withColumns(exprs))

    def fill(self, value) -> "ArrayTable":
        return self._with(self.df.withColumns({v: F.lit(value).cast(t.spark) for v, t in zip(self.values, self.types)}))

    def all_equal(self, value) -> bool:
        ok = reduce(lambda a, b: a & b, [F.col(v) == F.lit(value) for v in self.values])
        return bool(self.df.agg(F.coalesce(F.bool_and(ok), F.lit(True))).first()[0])

    def copy_from(self, src: "ArrayTable") -> "ArrayTable":
        """Values of ``src`` where both have the point."""
        s = src.df.select(*[F.col(a).alias(b) for a, b in zip(src.dims, self.dims)], *[F.col(a).alias(f"_src_{b}") for a, b in zip(src.values, self.values)])
        j = self.df.join(s, list(self.dims), "left")
        return self._with(j.select(*self.dims, *[F.coalesce(f"_src_{v}", v).alias(v) for v in self.values]))

    def for_each_value(self, f, *others: "ArrayTable") -> "ArrayTable":
        """v = f(v, v1, ...) at points that all tables have."""
        df = self.df
        for i, o in enumerate(others):
            df = df.join(o.df.select(*[F.col(a).alias(b) for a, b in zip(o.dims, self.dims)], F.col(o.values[0]).alias(f"_o{i}")), list(self.dims))
        return self._with(df.select(*self.dims, f(F.col(self.values[0]), *[F.col(f"_o{i}") for i in range(len(others))]).alias(self.values[0])), values=self.values[:1], types=self.types[:1])

    def concat(self, other: "ArrayTable", d=0) -> "ArrayTable":
        """``other`` after this table along a dimension."""
        i = self._at(d)
        moved = other.translate(i, self.region[i].max + 1 - other.region[i].min)
        df = self.df.select(*self.dims, *self.values).union(moved.df.select(*other.dims, *other.values))
        return self._with(df, region=(*self.region[:i], Range(self.region[i].min, self.region[i].extent + other.region[i].extent), *self.region[i + 1 :]))

    def interleave(self, other: "ArrayTable", d=0) -> "ArrayTable":
        """Even places from this table, odd ones from ``other``."""
        i, c = self._at(d), self.dims[self._at(d)]
        a = self.df.select(*self.dims, *self.values).withColumn(c, F.col(c) * 2)
        b = other.df.select(*[F.col(x).alias(y) for x, y in zip(other.dims, self.dims)], *[F.col(x).alias(y) for x, y in zip(other.values, self.values)]).withColumn(c, F.col(c) * 2 + 1)
        r = None if self.region is None else (*self.region[:i], Range(2 * self.region[i].min, 2 * self.region[i].extent), *self.region[i + 1 :])
        return self._with(a.unionByName(b), region=r)

    def deinterleave(self, d=0, channel: str = "c") -> "ArrayTable":
        """x becomes (x div 2, x mod 2)."""
        c = self.dims[self._at(d)]
        df = self.df.withColumn(channel, F.pmod(c, F.lit(2)).cast("int")).withColumn(c, F.floor(F.col(c) / 2).cast("int"))
        r = None if self.region is None else (*[Range(x.min // 2, (x.extent + 1) // 2) if i == self._at(d) else x for i, x in enumerate(self.region)], Range(0, 2))
        return self._with(df, dims=(*self.dims, channel), region=r)

    # metadata ----------------------------------------------------------------
    def dim(self, d) -> Range:
        return self.region[self._at(d)]

    width = property(lambda self: self.region[0].extent)
    height = property(lambda self: self.region[1].extent)
    channels = property(lambda self: self.region[2].extent)
    left = property(lambda self: self.region[0].min)
    right = property(lambda self: self.region[0].max)
    top = property(lambda self: self.region[1].min)
    bottom = property(lambda self: self.region[1].max)

    def number_of_elements(self) -> int:
        return reduce(lambda a, r: a * r.extent, self.region, 1)

    def size_in_bytes(self) -> int:
        return self.number_of_elements() * sum(max(8, t.bits) // 8 for t in self.types)

    def contains(self, *coords: int) -> bool:
        return all(r.min <= c <= r.max for r, c in zip(self.region, coords))

    def at(self, *coords: int):
        cond = reduce(lambda a, b: a & b, [F.col(d) == c for d, c in zip(self.dims, coords)], F.lit(True))
        row = self.df.where(cond).select(*self.values).first()
        return row and (row[0] if len(row) == 1 else tuple(row))

    def at_many(self, points: DataFrame) -> DataFrame:
        """``points`` (dims) with the values there: element access without a driver."""
        return points.join(self.df.select(*self.dims, *self.values), list(self.dims), "left")

    def as_type(self, type: ElementType, rank: int) -> "ArrayTable":
        """This table, if it has the element type and the rank; an error if not."""
        if len(self.dims) != rank or any(t != type for t in self.types):
            raise TypeError(f"{self.types} in {len(self.dims)} dimensions, not {type} in {rank}")
        return self

    def with_shape_of(self, other: "ArrayTable", value=0) -> "ArrayTable":
        """An array over the region of another, filled with a value, with this one's types."""
        df = domain(self.df.sparkSession, list(other.dims), other.region)
        return ArrayTable(df.select("*", *[F.lit(value).cast(t.spark).alias(v) for v, t in zip(self.values, self.types)]), other.dims, self.values, self.types, other.region)

    def interleaved(self, channel) -> "ArrayTable":
        """The channel first: the order of dims in which it varies fastest."""
        i = self._at(channel)
        order = [i, *[k for k in range(len(self.dims)) if k != i]]
        return self._with(self.df.select(*[self.dims[k] for k in order], *self.values), dims=tuple(self.dims[k] for k in order), region=None if self.region is None else tuple(self.region[k] for k in order))

    def planar(self, channel) -> "ArrayTable":
        """The channel last."""
        i = self._at(channel)
        order = [*[k for k in range(len(self.dims)) if k != i], i]
        return self._with(self.df.select(*[self.dims[k] for k in order], *self.values), dims=tuple(self.dims[k] for k in order), region=None if self.region is None else tuple(self.region[k] for k in order))

    def describe(self) -> DataFrame:
        """A row a dimension: place, name, min, extent, and the stride of a dense layout in
        which the first varies fastest."""
        rows, step = [], 1
        for i, (d, r) in enumerate(zip(self.dims, self.region)):
            rows.append((i, d, r.min, r.extent, step))
            step *= r.extent
        return self.df.sparkSession.createDataFrame(rows, "place int, dim string, min int, extent int, stride long")

    def check_dense(self) -> bool:
        """Whether each point of the region has exactly one row."""
        n, distinct = self.df.agg(F.count("*"), F.count_distinct(*self.dims)).first()
        return n == distinct == self.number_of_elements()

    def to_scanlines(self, d=0) -> DataFrame:
        """The innermost dimension packed: other dims, vals."""
        c = self.dims[self._at(d)]
        rest = [x for x in self.dims if x != c]
        packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(c), *self.values))), lambda s: s[self.values[0]])
        return self.df.groupBy(*rest).agg(packed.alias("vals"))


def make_scalar(spark: SparkSession, value, type: ElementType = F64) -> ArrayTable:
    return ArrayTable(spark.range(1).select(F.lit(value).cast(type.spark).alias("v")), (), ("v",), (type,), ())


def generate(spark: SparkSession, dims: tuple[str, ...], region, value: Column, type: ElementType = I32) -> ArrayTable:
    """for_each_element: a value for each point of a box."""
    r = box(*region)
    return ArrayTable(domain(spark, list(dims), r).withColumn("v", value.cast(type.spark)), dims, ("v",), (type,), r)
