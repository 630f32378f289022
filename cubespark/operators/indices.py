"""The normalised difference of near-infrared and red."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..cube import DataCube
from ..errors import BandExists, DimensionAmbiguous, NirBandAmbiguous, RedBandAmbiguous
from ..schema import Dim


def ndvi(cube: DataCube, *, nir: str = "nir", red: str = "red", target_band: str | None = None, bands_dim: str = "bands") -> DataCube:
    """(nir - red) / (nir + red), in [-1, 1]; values of 0 or less are no-data.

    One pass groups the two bands' cells; without ``target_band`` the bands dimension goes, else its cells are added
    as a band and the others stay as they are.
    """
    cube.need_raster()
    if bands_dim not in cube.schema.names:
        raise DimensionAmbiguous(f"no dimension {bands_dim!r} of bands")
    known = cube.labels(bands_dim)
    if nir not in known:
        raise NirBandAmbiguous(f"no band {nir!r}; there are {known}")
    if red not in known:
        raise RedBandAmbiguous(f"no band {red!r}; there are {known}")
    if target_band is not None and target_band in known:
        raise BandExists(f"band {target_band!r} is there already")
    keys, value = cube.schema.others(bands_dim), cube.schema.value
    of = lambda band: F.max(F.when((F.col(bands_dim) == band) & (F.col(value) > 0), F.col(value)))
    two = cube.df.where(F.col(bands_dim).isin(nir, red)).groupBy(*keys).agg(of(nir).alias("__n"), of(red).alias("__r"))
    n, r = F.col("__n"), F.col("__r")
    index = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(n - r, n + r)))
    index = F.when(n.isNotNull() & r.isNotNull(), index).cast("double")
    if target_band is None:
        return cube.of(two.select(*keys, index.alias(value)), cube.schema.without(bands_dim))
    added = two.select(*keys, F.lit(target_band).alias(bands_dim), index.alias(value))
    df = cube.df.select(*cube.schema.names, F.col(value).cast("double").alias(value)).unionByName(added)
    return cube.of(df, replace(cube.schema.with_dim(Dim(bands_dim, "bands", (*known, target_band)))))
