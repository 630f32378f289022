"""Filters and elementwise functions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import DataCube
from ..schema import Dim


def filter_bbox(cube: DataCube, *, west, south, east, north, x_dim="longitude", y_dim="latitude") -> DataCube:
    """Cells whose centres lie in the box, its edges included; the conditions reach the scan."""
    cube.schema.dim(x_dim), cube.schema.dim(y_dim)
    schema = cube.schema
    for name, lo, hi in ((x_dim, west, east), (y_dim, south, north)):
        d = schema.dim(name)
        if d.labels is not None:
            schema = schema.with_dim(Dim(name, d.role, tuple(v for v in d.labels if lo <= v <= hi)))
    return cube.of(cube.df.where(F.col(x_dim).between(west, east) & F.col(y_dim).between(south, north)), schema)


def _after(text: str) -> str:
    """The first moment after what a date text names: a year, month, day, hour, minute, or second."""
    t = text.strip().replace("T", " ").removesuffix("Z")
    if re.fullmatch(r"\d{4}", t):
        return f"{int(t) + 1:04d}-01-01 00:00:00"
    if re.fullmatch(r"\d{4}-\d{2}", t):
        y, m = map(int, t.split("-"))
        return f"{y + m // 12:04d}-{m % 12 + 1:02d}-01 00:00:00"
    for form, step in (("%Y-%m-%d", timedelta(days=1)), ("%Y-%m-%d %H", timedelta(hours=1)), ("%Y-%m-%d %H:%M", timedelta(minutes=1)), ("%Y-%m-%d %H:%M:%S", timedelta(seconds=1))):
        try:
            return (datetime.strptime(t, form) + step).strftime("%Y-%m-%d %H:%M:%S")
        except ValueError:
            continue
    return (datetime.fromisoformat(t) + timedelta(microseconds=1)).strftime("%Y-%m-%d %H:%M:%S.%f")


def _from(text: str) -> str:
    t = text.strip().replace("T", " ").removesuffix("Z")
    if re.fullmatch(r"\d{4}", t):
        t = f"{t}-01"
    if re.fullmatch(r"\d{4}-\d{2}", t):
        t = f"{t}-01"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", t):
        t = f"{t} 00"
    return t + ":00:00"[: max(0, 19 - len(t))] if len(t) < 19 else t


def _text(v) -> str | None:
    if v is None:
        return None
    return v.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(v, datetime) else str(v)


def bounds(extent) -> tuple[str | None, str | None]:
    """The first moment of a closed interval and the first after it; None: open."""
    lo, hi = map(_text, extent)
    return (None if lo is None else _from(lo)), (None if hi is None else _after(hi))


def temporal_bounds(t_dim: str, extent) -> Column:
    lo, hi = bounds(extent)
    c = F.lit(True)
    if lo is not None:
        c = c & (F.col(t_dim) >= F.lit(lo).cast("timestamp"))
    if hi is not None:
        c = c & (F.col(t_dim) < F.lit(hi).cast("timestamp"))
    return c


def filter_temporal(cube: DataCube, *, extent, t_dim: str = "time") -> DataCube:
    """Cells in a closed interval; a partial date at its end stands for all of the day, month or year."""
    cube.schema.dim(t_dim)
    return cube.of(cube.df.where(temporal_bounds(t_dim, extent)), cube.schema.with_dim(Dim(t_dim, "temporal")))


def filter_bands(cube: DataCube, bands, bands_dim: str = "bands") -> DataCube:
    known = cube.labels(bands_dim)
    for b in bands:
        if b not in known:
            raise ValueError(f"no band {b!r}; there are {known}")
    return cube.of(cube.df.where(F.col(bands_dim).isin(list(bands))), cube.schema.with_dim(Dim(bands_dim, "bands", tuple(bands))))


def apply(cube: DataCube, process, *, context=None) -> DataCube:
    """A function of each value: of the Column where it takes one, else of arrays of values (NaN: no data)."""
    cube.need_raster()
    v, more = F.col(cube.schema.value), {} if context is None else {"context": context}
    try:
        out = process(v, **more)
    except (TypeError, ValueError, AttributeError, PySparkException):  # not a function of a Column: it is then one of arrays
        out = None
    if not isinstance(out, Column):
        call = F.pandas_udf(lambda s: pd.Series(process(s.to_numpy(dtype=float), **more), dtype=float), "double")
        out = F.when(~F.isnan(call(v.cast("double"))), call(v.cast("double")))
    return cube.of(cube.df.withColumn(cube.schema.value, out))
