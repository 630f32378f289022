"""Masks: cells replaced where another cube, or polygons, say so."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import DataCube
from ..errors import DimensionNotAvailable, IncompatibleDataCubes
from ..functions import geometry as G


def _replaced(value: Column, masked: Column, replacement) -> Column:
    """Masked cells replaced; those without data stay without."""
    return F.when(value.isNull(), F.lit(None)).when(masked, F.lit(replacement)).otherwise(value)


def nearest_labels(ours: list[float], theirs: list[float]) -> list[float | None]:
    """For each of our labels the nearest of theirs, the lower for a tie; None outside their range."""
    at = np.asarray(sorted(theirs), dtype=float)
    out: list[float | None] = []
    for v in ours:
        if not len(at) or v < at[0] or v > at[-1]:
            out.append(None)
            continue
        i = int(np.searchsorted(at, v))
        if i and (i == len(at) or v - at[i - 1] <= at[i] - v):
            i -= 1
        out.append(float(at[i]))
    return out


def mask(cube: DataCube, mask_cube: DataCube, *, replacement=None, x_dim: str = "longitude", y_dim: str = "latitude") -> DataCube:
    """Cells replaced where the mask is true or not zero; a mask cell without data masks, as does lying outside it.

    The mask's dimensions must be among the cube's, with equal labels but for x and y, where its nearest cell counts.
    A mask without some dimension holds for all its labels.
    """
    cube.need_raster()
    mask_cube.need_raster()
    names = mask_cube.schema.names
    for n in names:
        if n not in cube.schema.names:
            raise IncompatibleDataCubes(f"the cube has no dimension {n!r}")
        if n not in (x_dim, y_dim) and cube.labels(n) != mask_cube.labels(n):
            raise IncompatibleDataCubes(f"labels of dimension {n!r} differ")
    df = cube.df
    spark = df.sparkSession
    m = mask_cube.df.select(*[F.col(n).alias(f"__m_{n}") for n in names], F.col(mask_cube.schema.value).alias("__m"), F.lit(True).alias("__there"))
    on = F.lit(True)
    for n in names:
        key = F.col(n)
        if n in (x_dim, y_dim) and cube.labels(n) != mask_cube.labels(n):
            ours = cube.labels(n)
            pairs = [(a, b) for a, b in zip(map(float, ours), nearest_labels(ours, mask_cube.labels(n)), strict=True)]
            axis = spark.createDataFrame(pairs, f"`__l_{n}` double, `__a_{n}` double")  # a row for each label of the axis
            df = df.join(F.broadcast(axis), F.col(n) == F.col(f"__l_{n}"), "left").drop(f"__l_{n}")
            key = F.col(f"__a_{n}")
        on = on & (key == F.col(f"__m_{n}"))
    joined = df.join(m, on, "left")
    number = F.col("__m") if dict(mask_cube.df.dtypes)[mask_cube.schema.value] == "boolean" else F.col("__m") != 0
    masked = F.coalesce(number, F.lit(True))
    return cube.of(joined.select(*cube.schema.names, _replaced(F.col(cube.schema.value), masked, replacement).alias(cube.schema.value)))


def mask_polygon(cube: DataCube, mask_geom, *, replacement=None, inside: bool = False, x_dim: str = "longitude", y_dim: str = "latitude") -> DataCube:
    """Cells replaced whose centres lie outside all polygons (``inside``: in one); true centres count."""
    cube.need_raster()
    for n in (x_dim, y_dim):
        if n not in cube.schema.names:
            raise DimensionNotAvailable(f"no dimension {n!r}")
    hit = G.contains_fixed(G.polygons(mask_geom), F.col(x_dim), F.col(y_dim))
    value = cube.schema.value
    return cube.of(cube.df.withColumn(value, _replaced(F.col(value), hit if inside else ~hit, replacement)))
