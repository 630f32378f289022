"""The cube: a DataFrame of cells (or of features) and what is known of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import CubeSchema, Dim


@dataclass(frozen=True)
class DataCube:
    """Immutable; each operator returns another cube.

    Raster cubes have a row for each cell: its dimensions and ``schema.value`` (NULL: no data).  Vector cubes have
    attributes and geometry columns.
    """

    df: DataFrame
    schema: CubeSchema
    _labels: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def is_raster(self) -> bool:
        return self.schema.kind == "raster"

    @property
    def is_vector(self) -> bool:
        return self.schema.kind == "vector"

    @property
    def data(self) -> DataFrame:
        return self.df

    def __repr__(self) -> str:
        return f"DataCube({self.schema.kind}, {', '.join(self.schema.names)})"

    def need_raster(self) -> None:
        if not self.is_raster:
            raise TypeError("a raster cube is needed")

    def need_vector(self) -> None:
        if not self.is_vector:
            raise TypeError("a vector cube is needed")

    def labels(self, name: str) -> list:
        """A dimension's labels, in order: those of the schema, or else those in the data, sorted and remembered."""
        dim = self.schema.dim(name)
        if dim.labels is not None:
            return list(dim.labels)
        if name not in self._labels:
            self._labels[name] = sorted(r[0] for r in self.df.select(name).distinct().collect())
        return self._labels[name]

    def of(self, df: DataFrame, schema: CubeSchema | None = None) -> DataCube:
        return DataCube(df, schema or self.schema)

    def densify(self) -> DataCube:
        """A row for each combination of labels; those without a cell get no-data."""
        self.need_raster()
        axes = self.df.sparkSession.range(1)
        for n in self.schema.names:
            kind = self.df.schema[n].dataType.simpleString()
            axes = axes.withColumn(n, F.explode(F.array(*[F.lit(v) for v in self.labels(n)]).cast(f"array<{kind}>")))
        df = axes.drop("id").join(self.df, self.schema.names, "left").select(*self.schema.names, self.schema.value)
        return self.of(df)

    def with_labels(self, name: str, labels) -> DataCube:
        d = self.schema.dim(name)
        return self.of(self.df, self.schema.with_dim(Dim(d.name, d.role, tuple(labels))))

    def compute(self) -> DataCube:
        """The same cube, evaluated and kept."""
        df = self.df.persist()
        df.count()
        return replace(self, df=df)

    def to_pandas(self):
        return self.df.toPandas()

    # sources

    @staticmethod
    def load_collection(collection_id: str, **kwargs) -> DataCube:
        from .sources import load_collection

        return load_collection(collection_id, **kwargs)

    @staticmethod
    def load_stac(spark, source, **kwargs) -> DataCube:
        from .sources import load_stac

        return load_stac(spark, source, **kwargs)

    @staticmethod
    def load_geojson(spark, source, **kwargs) -> DataCube:
        from .sources import load_geojson

        return load_geojson(spark, source, **kwargs)

    def save_result(self, path: str, format: str = "parquet", **kwargs) -> bool:
        from .sources import save_result

        return save_result(self, path, format, **kwargs)

    # raster and vector

    def filter_bbox(self, *, west: float, south: float, east: float, north: float, x_dim: str = "longitude", y_dim: str = "latitude") -> DataCube:
        from .operators import filters, vector

        if self.is_vector:
            return vector.filter_bbox(self, west=west, south=south, east=east, north=north)
        return filters.filter_bbox(self, west=west, south=south, east=east, north=north, x_dim=x_dim, y_dim=y_dim)

    def apply(self, process, *, context=None) -> DataCube:
        from .operators import filters, vector

        return (vector.apply if self.is_vector else filters.apply)(self, process, context=context)

    # raster

    def ndvi(self, **kwargs) -> DataCube:
        from .operators.indices import ndvi

        return ndvi(self, **kwargs)

    def filter_temporal(self, *, extent, t_dim: str = "time") -> DataCube:
        from .operators.filters import filter_temporal

        return filter_temporal(self, extent=extent, t_dim=t_dim)

    def filter_bands(self, bands, bands_dim: str = "bands") -> DataCube:
        from .operators.filters import filter_bands

        return filter_bands(self, bands, bands_dim)

    def aggregate_spatial(self, geometries=None, reducer: str = "mean", **kwargs):
        from .operators.zonal import aggregate_spatial

        return aggregate_spatial(self, geometries, reducer, **kwargs)

    def aggregate_temporal(self, *, period: str = "month", reducer: str = "mean", t_dim: str = "time", dimension: str | None = None, fill_gaps: bool = True) -> DataCube:
        from .operators.temporal import aggregate_temporal

        return aggregate_temporal(self, period=period, reducer=reducer, t_dim=dimension or t_dim, fill_gaps=fill_gaps)

    aggregate_temporal_period = aggregate_temporal

    def resample_spatial(self, **kwargs) -> DataCube:
        from .operators.resample import resample_spatial

        return resample_spatial(self, **kwargs)

    def reduce_dimension(self, reducer, *, dimension: str, context=None) -> DataCube:
        from .operators.reduce import reduce_dimension

        return reduce_dimension(self, reducer, dimension=dimension, context=context)

    def drop_dimension(self, *, name: str) -> DataCube:
        from .operators.reduce import drop_dimension

        return drop_dimension(self, name=name)

    def apply_kernel(self, **kwargs) -> DataCube:
        from .operators.kernel import apply_kernel

        return apply_kernel(self, **kwargs)

    def array_interpolate_linear(self, *, dimension: str | None = None) -> DataCube:
        from .operators.interpolate import array_interpolate_linear

        return array_interpolate_linear(self, dimension=dimension)

    def mask(self, mask_cube: DataCube, **kwargs) -> DataCube:
        from .operators.mask import mask

        return mask(self, mask_cube, **kwargs)

    def mask_polygon(self, mask_geom, **kwargs) -> DataCube:
        from .operators.mask import mask_polygon

        return mask_polygon(self, mask_geom, **kwargs)

    def cloud_detection(self, **kwargs) -> DataCube:
        from .operators.clouds import cloud_detection

        return cloud_detection(self, **kwargs)

    # vector

    def vector_buffer(self, *, distance: float) -> DataCube:
        from .operators.vector import vector_buffer

        return vector_buffer(self, distance=distance)

    def vector_reproject(self, *, projection, dimension: str | None = None) -> DataCube:
        from .operators.vector import vector_reproject

        return vector_reproject(self, projection=projection, dimension=dimension)

    def filter_vector(self, geometries, relation: str = "intersects") -> DataCube:
        from .operators.vector import filter_vector

        return filter_vector(self, geometries, relation)
