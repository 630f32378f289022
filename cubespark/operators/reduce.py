"""Dimensions reduced or dropped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..cube import DataCube
from ..errors import DimensionLabelCountMismatch
from ..functions.reducers import resolve


def reduce_dimension(cube: DataCube, reducer, *, dimension: str, context=None) -> DataCube:
    """A dimension's values reduced to one, for each combination of the others; no-data makes the result no-data.

    Named reducers are aggregates.  A callable gets the values in label order, ``axis`` and, if given, ``context``,
    for one group at a time.
    """
    cube.need_raster()
    cube.schema.dim(dimension)
    native, call = resolve(reducer)
    keys, value = cube.schema.others(dimension), cube.schema.value
    if native is not None:
        return cube.of(cube.df.groupBy(*keys).agg(native(F.col(value)).alias(value)), cube.schema.without(dimension))
    more = {} if context is None else {"context": context}
    kinds = ", ".join([f"`{k}` {cube.df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{value}` double"])

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(dimension)[value].to_numpy(dtype=float)
        out = float(np.asarray(call(v, axis=0, **more)))
        return pd.DataFrame([[*key, None if np.isnan(out) else out]], columns=[*keys, value])

    return cube.of(cube.df.groupBy(*keys).applyInPandas(work, kinds), cube.schema.without(dimension))


def drop_dimension(cube: DataCube, *, name: str) -> DataCube:
    """The cube without a dimension of one label."""
    d = cube.schema.dim(name)
    n = len(d.labels) if d.labels is not None else cube.df.select(name).distinct().limit(2).count()
    if n > 1:
        raise DimensionLabelCountMismatch(f"dimension {name!r} has more than one label")
    if n == 0:
        raise DimensionLabelCountMismatch(f"dimension {name!r} has no label")
    return cube.of(cube.df.drop(name), cube.schema.without(name))
