"""Code from outside in a pipeline: scalar functions inside expressions, and stages that
make whole tables from tables.

A stage tells which region of its inputs it needs for a region of its output (its bounds
query), and may have several outputs.  It runs group by group, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession

from ..functions.expr import Expr, cast, node
from ..functions.types import ElementType
from ..operators.table import ArrayTable
from .func import Func, Image, _Lowering
from .region import Box, box

_SCALARS: dict[str, Callable[..., Expr]] = {}


def extern(name: str, type: ElementType, build: Callable[..., Column], *args: ElementType) -> Callable[..., Expr]:
    """Registers a scalar function of columns (a built-in, or a vectorized UDF) under a name;
    calls in expressions have ``type``, and their arguments the given ones, if any."""

    def call(*values: Expr) -> Expr:
        if args and len(args) != len(values):
            raise TypeError(f"{name} takes {len(args)} arguments")
        typed = [cast(t, v) for t, v in zip(args, values)] if args else list(values)
        return node(type, lambda *cs: build(*cs).cast(type.spark), *typed, tag=f"extern:{name}")

    _SCALARS[name] = call
    return call


def call_extern(name: str, *values: Expr) -> Expr:
    return _SCALARS[name](*values)


class Extern:
    """A stage: ``fn`` maps a pandas frame of one group of the first input (its dims and
    values) and the scalar arguments to a frame with the output's dims and values.

    ``groups`` are the dims whose every combination is one group (with none, the stage has
    no parallelism and its input has to fit one task); ``needs`` maps the region of the
    output, (min, extent) pairs, to that of the input."""

    def __init__(self, fn, dims: Sequence[str], types: Sequence[ElementType], outputs: Sequence[str] = ("v",), groups: Sequence[str] = (), needs=None):
        self.fn, self.dims, self.types, self.outputs, self.groups = fn, tuple(dims), tuple(types), tuple(outputs), tuple(groups)
        self.needs = needs or (lambda region: region)

    def input_region(self, region) -> Box:
        """The answer to a bounds query: what the first input has to supply."""
        return box(*self.needs(self._pairs(region)))

    @staticmethod
    def _pairs(region) -> list[tuple[int, int]]:
        return [(r.min, r.extent) for r in box(*region)]

    def realize(self, region, spark: SparkSession, source: Func | Image | ArrayTable, *scalars) -> ArrayTable:
        need = self.input_region(region)
        if isinstance(source, ArrayTable):
            source = Image(source)
        table = _Lowering(spark).array(source, need)
        fn, out = self.fn, box(*region)
        kinds = ", ".join([*[f"`{d}` int" for d in self.dims], *[f"`{v}` {t.spark}" for v, t in zip(self.outputs, self.types)]])

        def run(frame):
            return fn(frame, *scalars)

        df = table.df.groupBy(*self.groups).applyInPandas(run, kinds)
        for d, r in zip(self.dims, out):
            df = df.where(df[d].between(r.min, r.max))
        return ArrayTable(df, self.dims, self.outputs, self.types, out)

    def image(self, region, spark: SparkSession, source, *scalars) -> Image:
        """The output as an input of other functions."""
        return Image(self.realize(region, spark, source, *scalars))
