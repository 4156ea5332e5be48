"""Parameterised pipelines: classes that make functions from inputs and settings.

    class Blur(Generator):
        radius = Parameter(1)
        image = Input(2)
        result = Output(2)

        def generate(self):
            ...
            self.result[x, y] = ...

    Blur(radius=2)([w, h], spark, table)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.types import ElementType
from ..operators.table import ArrayTable
from .func import Func, Image, Pipeline

_REGISTERED: dict[str, type["Generator"]] = {}


class Parameter:
    """A setting fixed when the pipeline is made; ``choices`` or a range may bound it."""

    def __init__(self, default, choices=None, min=None, max=None):
        self.default, self.choices, self.min, self.max = default, choices, min, max

    def check(self, name: str, value):
        if self.choices is not None and value not in self.choices or self.min is not None and value < self.min or self.max is not None and value > self.max:
            raise ValueError(f"{name} cannot be {value!r}")
        return value


class Input:
    """An array of ``dims`` coordinates, given at each call."""

    def __init__(self, dims: int, type: ElementType | None = None):
        self.dims, self.type = dims, type


class Output:
    def __init__(self, dims: int, type: ElementType | None = None):
        self.dims, self.type = dims, type


class Generator:
    """Inputs are bound in the order of their declaration; a call builds the pipeline for
    their types and realizes its outputs."""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        _REGISTERED[cls.__name__] = cls

    def __init__(self, **settings):
        own = {k: v for c in reversed(type(self).__mro__) for k, v in vars(c).items()}
        self._inputs = [k for k, v in own.items() if isinstance(v, Input)]
        self._outputs = [k for k, v in own.items() if isinstance(v, Output)]
        self._declared = own
        for k, v in own.items():
            if isinstance(v, Parameter):
                setattr(self, k, v.check(k, settings.pop(k, v.default)))
        if settings:
            raise TypeError(f"no settings {sorted(settings)}")
        self.configure()

    def configure(self) -> None:
        """May add parameters, inputs and outputs that depend on the settings."""

    def generate(self) -> None:
        raise NotImplementedError

    def schedule(self) -> None:
        """Directives, after ``generate``."""

    def build(self, *tables: ArrayTable) -> Pipeline:
        """The pipeline over the given arrays."""
        if len(tables) != len(self._inputs):
            raise TypeError(f"{len(self._inputs)} inputs are wanted")
        for name, table in zip(self._inputs, tables):
            want = self._declared[name]
            setattr(self, name, Image(table, want.dims, want.type))
        for name in self._outputs:
            setattr(self, name, Func(name))
        self.generate()
        self.schedule()
        for name in self._outputs:
            f, want = getattr(self, name), self._declared[name]
            if not f.values or len(f.args) != want.dims or want.type is not None and f.values[0].type != want.type:
                raise TypeError(f"{name} is not the output that was declared")
        return Pipeline(*[getattr(self, name) for name in self._outputs])

    def __call__(self, region, spark: SparkSession, *tables: ArrayTable):
        got = self.build(*tables).realize(region, spark)
        return got[0] if len(got) == 1 else got


def names() -> list[str]:
    return sorted(_REGISTERED)


def create(name: str, **settings) -> Generator:
    """A registered generator by name, as from a command line."""
    return _REGISTERED[name](**settings)
