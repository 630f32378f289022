"""Scalar processes, on Columns (lazily) and on Python values."""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence
from numbers import Number

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArrayElementNotAvailable, ArrayElementParameterConflict, ArrayElementParameterMissing, ArrayNotLabeled


def plain(x):
    """A NumPy scalar as the Python value it holds."""
    return x.item() if isinstance(x, np.generic) or (isinstance(x, np.ndarray) and x.ndim == 0) else x


def as_list(data) -> list:
    """A one-dimensional array or sequence, not a text, as a list."""
    if isinstance(data, np.ndarray):
        if data.ndim != 1:
            raise TypeError("an array of one dimension is needed")
        return [plain(v) for v in data]
    if isinstance(data, Sequence) and not isinstance(data, (str, bytes)):
        return [plain(v) for v in data]
    raise TypeError(f"an array is needed, not {type(data).__name__}")


def _family(x) -> str:
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, Number):
        return "number"
    if isinstance(x, str):
        return "string"
    raise TypeError(f"values of type {type(x).__name__} cannot be compared")


def eq(x, y, *, delta: float | None = None, case_sensitive: bool = True):
    """Equality: null for a null operand, False across types; within ``delta`` for numbers, by case for texts.

    Columns compare as the type they have, which the caller gives by ``cast``; numbers and texts in one comparison
    come from ``eq_mixed``.
    """
    if isinstance(x, Column) or isinstance(y, Column):
        a, b = (v if isinstance(v, Column) else F.lit(v) for v in (x, y))
        if not case_sensitive:
            return F.lower(a) == F.lower(b)
        if delta is not None and delta > 0:
            return F.abs(a - b) <= F.lit(float(delta))
        return a == b
    x, y = plain(x), plain(y)
    if x is None or y is None:
        return None
    if _family(x) != _family(y):
        return False
    if isinstance(x, str):
        return x == y if case_sensitive else x.casefold() == y.casefold()
    if not isinstance(x, bool) and delta is not None and delta > 0:
        return abs(x - y) <= delta
    return x == y


def eq_mixed(x: Column, y: Column) -> Column:
    """Equality of Columns of different families: False unless one is null."""
    return F.when(x.isNotNull() & y.isNotNull(), F.lit(False))


def or_(x, y):
    """Disjunction with three values."""
    if isinstance(x, Column) or isinstance(y, Column):
        a, b = (v if isinstance(v, Column) else F.lit(v).cast("boolean") for v in (x, y))
        return a | b
    x, y = plain(x), plain(y)
    for v in (x, y):
        if v is not None and not isinstance(v, bool):
            raise TypeError("booleans or null are needed")
    if x is True or y is True:
        return True
    return None if x is None or y is None else False


def _nothing(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def median(data, *, ignore_nodata: bool = True):
    """The middle of the numbers, the mean of both middles for an even count; null for none."""
    if isinstance(data, Column):
        kept = F.filter(data, lambda v: v.isNotNull() & ~F.isnan(v))
        s = F.array_sort(kept)
        n = F.size(s)
        mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
        ok = n > 0 if ignore_nodata else (n > 0) & (n == F.size(data))
        return F.when(ok, mid)
    values = as_list(data)
    if any(isinstance(v, (bool, str)) or not (v is None or isinstance(v, Number)) for v in values):
        raise TypeError("numbers or null are needed")
    kept = [v for v in values if not _nothing(v)]
    if not kept or (not ignore_nodata and len(kept) < len(values)):
        return None
    return statistics.median(kept)


def array_element(data, *, index: int | None = None, label=None, return_nodata: bool = False):
    """The element at a place from 0; a negative place is out of range."""
    if index is None and label is None:
        raise ArrayElementParameterMissing("an index or a label is needed")
    if index is not None and label is not None:
        raise ArrayElementParameterConflict("an index and a label are given")
    if label is not None:
        raise ArrayNotLabeled("the array has no labels")
    if isinstance(data, Column):
        if return_nodata:
            return F.get(data, F.lit(index))
        ok = (F.size(data) > index) & F.lit(index >= 0)
        return F.when(ok, F.get(data, F.lit(index))).otherwise(F.raise_error(F.lit("the array has no such element")))
    values = as_list(data)
    if 0 <= index < len(values):
        return values[index]
    if return_nodata:
        return None
    raise ArrayElementNotAvailable(f"the array has no element {index}")


def array_interpolate_linear(data):
    """Fills gaps between two numbers by their places; gaps at the ends stay, as does an array with under two numbers."""
    if isinstance(data, Column):
        n = F.size(data)
        ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        places = F.filter(F.transform(data, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: ok(s["v"]))

        def fill(v, i):
            before = F.filter(places, lambda s: s["i"] < i)
            after = F.filter(places, lambda s: s["i"] > i)
            a, b = F.get(before, F.size(before) - 1), F.get(after, F.lit(0))
            return F.when(ok(v), v).otherwise(a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / (b["i"] - a["i"]))

        return F.when(n.isNotNull(), F.transform(data.cast("array<double>"), fill))
    values = as_list(data)
    known = [(i, v) for i, v in enumerate(values) if isinstance(v, Number) and math.isfinite(v)]
    if len(known) < 2:
        return values
    out = [v if isinstance(v, Number) and math.isfinite(v) else None for v in values]
    for (i, a), (j, b) in zip(known, known[1:], strict=False):
        for k in range(i + 1, j):
            v = a + (b - a) * (k - i) / (j - i)
            out[k] = int(v) if float(v).is_integer() else v
    return out
