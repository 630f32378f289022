"""From cells to samples with features, and back."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cube import DataCube
from ..schema import Dim


def wide(cube: DataCube, bands: list[str], bands_dim: str = "bands") -> DataFrame:
    """A column for each band; the labels are given, so no job looks for them."""
    keys, value = cube.schema.others(bands_dim), cube.schema.value
    return cube.df.where(F.col(bands_dim).isin(bands)).groupBy(*keys).pivot(bands_dim, bands).agg(F.first(value))


def feature_names(cube: DataCube, dims: list[str]) -> list[tuple]:
    return list(product(*[cube.labels(d) for d in dims]))


def stack_to_samples(cube: DataCube, feature_dim="bands") -> tuple[DataFrame, list[str]]:
    """A row for each combination of the other labels, with ``features``, in the order of the listed dimensions."""
    cube.need_raster()
    dims = [feature_dim] if isinstance(feature_dim, str) else list(feature_dim)
    if not dims:
        raise ValueError("a feature dimension is needed")
    for d in dims:
        cube.schema.dim(d)
    keys, value = cube.schema.others(*dims), cube.schema.value
    combos = feature_names(cube, dims)
    kinds = [dict(cube.df.dtypes)[d] for d in dims]

    def of(combo):
        here = F.lit(True)
        for d, k, v in zip(dims, kinds, combo, strict=True):
            here = here & (F.col(d) == F.lit(v).cast(k))
        return F.max(F.when(here, F.col(value).cast("double")))

    names = ["_".join(map(str, c)) for c in combos]
    out = cube.df.groupBy(*keys).agg(*[of(c).alias(f"f{i}") for i, c in enumerate(combos)])
    return out.select(*keys, F.array(*[f"f{i}" for i in range(len(combos))]).alias("features")), names


def unstack_from_samples(result: DataFrame, template: DataCube, feature_dim="bands", value: str = "value") -> DataCube:
    """The cube of a result by sample; its dimensions ride along as columns."""
    dims = [feature_dim] if isinstance(feature_dim, str) else list(feature_dim)
    schema = template.schema.without(*dims)
    return template.of(result.select(*schema.names, F.col(value).alias(schema.value)), schema)


def add_dimension(cube: DataCube, name: str, label, role: str = "other") -> DataCube:
    return cube.of(cube.df.withColumn(name, F.lit(label)).select(*cube.schema.names, name, cube.schema.value), cube.schema.with_dim(Dim(name, role, (label,))))


def rename_dimension(cube: DataCube, old: str, new: str) -> DataCube:
    d = cube.schema.dim(old)
    dims = tuple(Dim(new, d.role, d.labels) if x.name == old else x for x in cube.schema.dims)
    from dataclasses import replace

    return cube.of(cube.df.withColumnRenamed(old, new), replace(cube.schema, dims=dims))


def to_feature_matrix(cube, *, feature_columns=None, target_column: str | None = None) -> DataFrame:
    """``features`` (the numeric columns but the target, in order) and ``target`` of a table of features."""
    df = cube.df if isinstance(cube, DataCube) else cube
    if feature_columns is None:
        feature_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target_column]
    x = F.array(*[F.col(c).cast("double") for c in feature_columns]).alias("features")
    return df.select(x, *([F.col(target_column).alias("target")] if target_column else []))
