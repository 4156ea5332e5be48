"""Registered queries of the array engine, each with its SQL form."""

from . import apps, arrays, funcs, layers, programs, scalars, tensors


def queries() -> dict:
    return {k: q for m in (apps, arrays, funcs, layers, programs, scalars, tensors) for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in (apps, arrays, funcs, layers, programs, scalars, tensors) for k, (_, s) in m.QUERIES.items() if s}
