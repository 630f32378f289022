"""Aggregation by calendar periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions.periods import REGULAR, bins, label
from ..functions.reducers import SKIPPING
from ..schema import Dim


def aggregate_temporal(cube: DataCube, *, period: str = "month", reducer: str = "mean", t_dim: str = "time", fill_gaps: bool = True) -> DataCube:
    """Values of each period reduced, no-data skipped; times become the periods' labels (texts).

    For hours, days, weeks, months, seasons and years all bins from the first to the last appear for each
    combination of the other labels, those without a cell with no-data; for the others only what is there.
    """
    cube.need_raster()
    cube.schema.dim(t_dim)
    kind = cube.df.schema[t_dim].dataType.typeName()
    if not kind.startswith(("timestamp", "date")):
        raise TypeError(f"dimension {t_dim!r} holds {kind}, not times: it is aggregated already")
    if reducer not in SKIPPING:
        raise ValueError(f"unknown reducer {reducer!r}; there are {sorted(SKIPPING)}")
    t, keys, value = F.col(t_dim), cube.schema.others(t_dim), cube.schema.value
    by = label(period, t)
    out = cube.df.groupBy(by.alias(t_dim), *keys).agg(SKIPPING[reducer](F.col(value)).alias(value))
    if fill_gaps and period in REGULAR:
        span = cube.df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).where("lo is not null")
        all_bins = span.select(F.explode(bins(period, F.col("lo"), F.col("hi"))).alias(t_dim))
        if keys:
            # one row with all labels, beside each combination of the others
            row = span.select(bins(period, F.col("lo"), F.col("hi")).alias("__bins"))
            all_bins = cube.df.select(*keys).distinct().crossJoin(F.broadcast(row)).select(F.explode("__bins").alias(t_dim), *keys)
        out = all_bins.join(out, [t_dim, *keys], "left")
    order = [n for n in cube.schema.names]
    return cube.of(out.select(*order, value), cube.schema.with_dim(Dim(t_dim, "temporal")))
