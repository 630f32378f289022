"""Reducers by name, under both rules for no-data."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodata import propagate

INF = float("inf")


def _true(v: Column) -> Column:
    """Not zero; no-data is true, as NaN is."""
    return F.coalesce(v != 0, F.lit(True))


def _finite(v: Column) -> Column:
    return F.count(F.when(F.abs(v) != INF, v)).cast("double")


#: A reducer that skips no-data; a group without data has no-data, but a sum of 0 and a product of 1.
SKIPPING: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "average": F.avg,
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "prod": lambda v: F.coalesce(F.product(v), F.lit(1.0)),
    "any": lambda v: F.bool_or(_true(v)),
    "all": lambda v: F.bool_and(_true(v)),
    "count": lambda v: F.count(v).cast("double"),
}

_PLAIN = {"sum": F.sum, "prod": F.product}

#: A reducer for which one no-data value makes the result no-data; truth and counts are never no-data.
PROPAGATING: dict[str, Callable[[Column], Column]] = {
    name: (lambda f: lambda v: propagate(v, f(v)))(_PLAIN.get(name, f)) for name, f in SKIPPING.items() if name not in ("any", "all", "count")
} | {"any": SKIPPING["any"], "all": SKIPPING["all"], "count": _finite}

#: NumPy's reducers that skip NaN, as their native likes.
NAN_NAMES = {f"numpy.nan{k}": k for k in ("mean", "sum", "min", "max", "median", "std", "var", "prod")}


def resolve(reducer):
    """(native, None) for a name, or (None, callable) for a callable or a dotted path to one."""
    if callable(reducer):
        return None, reducer
    if not isinstance(reducer, str):
        raise TypeError(f"a reducer is a name or a callable, not {type(reducer).__name__}")
    if reducer in PROPAGATING:
        return PROPAGATING[reducer], None
    if reducer in NAN_NAMES:
        return SKIPPING[NAN_NAMES[reducer]], None
    module, _, name = reducer.rpartition(".")
    if module:
        try:
            return None, getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError):
            pass
    raise ValueError(f"unknown reducer {reducer!r}")
