"""Gaps filled along a dimension."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cube import DataCube


def array_interpolate_linear(cube: DataCube, *, dimension: str | None) -> DataCube:
    """No-data between two values along a dimension becomes linear in its labels (times, numbers) or places (texts).

    Gaps at the ends stay.  The cube must be dense along the dimension, as only rows that are there are filled.
    """
    cube.need_raster()
    if dimension is None:
        raise ValueError("a dimension is needed")
    cube.schema.dim(dimension)
    keys, value = cube.schema.others(dimension), cube.schema.value
    kind = dict(cube.df.dtypes)[dimension]
    order = F.col(dimension)
    if kind == "string":
        labels = cube.schema.dim(dimension).labels
        if labels is not None:
            order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(dimension))
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)
    df = cube.df
    if kind == "string":
        x = F.row_number().over(w).cast("double")
    elif kind.startswith("timestamp") or kind == "date":
        x = F.unix_micros(F.col(dimension).cast("timestamp")).cast("double")
    else:
        x = F.col(dimension).cast("double")
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    df = df.withColumn("__x", x).withColumn("__k", F.when(ok, F.struct(F.col("__x").alias("x"), v.alias("v"))))
    before = F.last("__k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__a", before).withColumn("__b", after)
    fill = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * F.try_divide(F.col("__x") - F.col("__a.x"), F.col("__b.x") - F.col("__a.x"))
    return cube.of(df.withColumn(value, F.when(F.col("__k").isNotNull(), v).otherwise(fill)).select(*cube.schema.names, value))
