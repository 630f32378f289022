"""Statistics over space: of whole slices, or of zones."""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions import geometry as G
from ..functions.crs import epsg
from ..functions.reducers import SKIPPING
from ..schema import CubeSchema, Dim


def aggregate_spatial(cube: DataCube, geometries=None, reducer: str = "mean", *, x_dim: str = "longitude", y_dim: str = "latitude", t_dim: str = "time", bands_dim: str = "bands"):
    """Both spatial dimensions reduced, no-data skipped; with geometries a vector cube, a column for each time and band.

    Geometries: a vector cube, GeoJSON (a dict or a path that Spark reads).  A cell counts for each polygon that
    contains its centre.  An unknown reducer is a mean, with a warning, where geometries are given.
    """
    cube.need_raster()
    value = cube.schema.value
    if geometries is None:
        if reducer not in SKIPPING:
            raise ValueError(f"unknown reducer {reducer!r}; there are {sorted(SKIPPING)}")
        keys = cube.schema.others(x_dim, y_dim)
        return cube.of(cube.df.groupBy(*keys).agg(SKIPPING[reducer](F.col(value)).alias(value)), cube.schema.without(x_dim, y_dim))
    if reducer not in SKIPPING:
        warnings.warn(f"unknown reducer {reducer!r}: the mean is taken", UserWarning, stacklevel=2)
        reducer = "mean"
    zones = geometries
    if not isinstance(zones, DataCube):
        from ..sources.geojson import load_geojson

        zones = load_geojson(cube.df.sparkSession, json.loads(zones) if isinstance(zones, str) and zones.lstrip().startswith("{") else zones)
    if cube.schema.crs and zones.schema.crs and epsg(cube.schema.crs) != epsg(zones.schema.crs):
        from .vector import vector_reproject

        zones = vector_reproject(zones, projection=cube.schema.crs)
    return flatten_zones(cube, zones, zone_values(cube, zones, reducer, x_dim, y_dim), x_dim, y_dim, t_dim, bands_dim)


def with_ids(zones: DataCube) -> DataFrame:
    """The zones with ``geom_id``; one made here comes from the row's content, so it is the same however often and in
    whatever order the zones are computed."""
    df = zones.df
    if "geom_id" in df.columns:
        return df
    own = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    again = F.row_number().over(Window.partitionBy("geom_id").orderBy("geom_id"))  # rows that are wholly equal
    return df.withColumn("geom_id", own).withColumn("geom_id", F.xxhash64("geom_id", again))


def in_zones(cells: DataFrame, zones: DataFrame, x: str, y: str, size: tuple[float, float]) -> DataFrame:
    """``cells`` with the ``geom_id`` of each polygon that contains them.

    Space is cut into boxes; a polygon is in each box that its envelope meets, a cell in one.  So the join is on the
    box, and only cells near a polygon are tried against its edges.
    """
    sx, sy = size
    box = G.bbox(F.col("geometry"))
    z = zones.select("geom_id", "geometry", *[c.alias(k) for k, c in box.items()])
    span = lambda lo, hi, s: F.sequence(F.floor(F.col(lo) / s).cast("long"), F.floor(F.col(hi) / s).cast("long"))
    z = z.withColumn("__bx", F.explode(span("xmin", "xmax", sx))).withColumn("__by", F.explode(span("ymin", "ymax", sy)))
    c = cells.withColumn("__cx", F.floor(F.col(x) / sx).cast("long")).withColumn("__cy", F.floor(F.col(y) / sy).cast("long"))
    inside = F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))
    j = c.join(z, (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & inside)
    return j.where(G.contains(F.col("geometry"), F.col(x), F.col(y))).select(*cells.columns, "geom_id")


def box_size(zones: DataFrame) -> tuple[float, float]:
    """Twice the mean envelope, so that a polygon meets a few boxes."""
    b = G.bbox(F.col("geometry"))
    w, h = zones.agg(F.avg(b["xmax"] - b["xmin"]), F.avg(b["ymax"] - b["ymin"])).first()
    fit = lambda v: 1.0 if not v else 2.0 ** math.ceil(math.log2(2 * v))
    return fit(w), fit(h)


def zone_values(cube: DataCube, zones: DataCube, reducer: str, x_dim: str, y_dim: str) -> DataFrame:
    """(geom_id, other dimensions, value): in long form."""
    z = with_ids(zones)
    keys, value = cube.schema.others(x_dim, y_dim), cube.schema.value
    hits = in_zones(cube.df, z, x_dim, y_dim, box_size(z))
    return hits.groupBy("geom_id", *keys).agg(SKIPPING[reducer](F.col(value)).alias(value))


def flatten_zones(cube: DataCube, zones: DataCube, values: DataFrame, x_dim, y_dim, t_dim, bands_dim) -> DataCube:
    """A row for each zone: its attributes and geometry, and ``<band>_<YYYY-MM>``, times first.

    Where two times share a month the whole time is in the name.
    """
    keys, value = cube.schema.others(x_dim, y_dim), cube.schema.value
    z = with_ids(zones)
    if not keys:
        flat = values.withColumnRenamed(value, "0")
        names = ["0"]
    else:
        combos: list[tuple[str, dict]] = []
        times = cube.labels(t_dim) if t_dim in keys else [None]
        short = [str(t)[:7] for t in times]
        stamp = short if len(set(short)) == len(short) else [str(t) for t in times]
        bands = cube.labels(bands_dim) if bands_dim in keys else [None]
        rest = [k for k in keys if k not in (t_dim, bands_dim)]
        if rest:
            raise ValueError(f"dimensions {rest} cannot be made columns; reduce them first")
        for t, s in zip(times, stamp, strict=True):
            for b in bands:
                name = "_".join(str(v) for v in (b, s if t is not None else None) if v is not None)
                combos.append((name, {k: v for k, v in ((t_dim, t), (bands_dim, b)) if v is not None}))
        cols = []
        for name, at in combos:
            here = F.lit(True)
            for k, v in at.items():
                here = here & (F.col(k) == F.lit(v))
            cols.append(F.max(F.when(here, F.col(value))).alias(name))
        flat = values.groupBy("geom_id").agg(*cols)
        names = [c[0] for c in combos]
    out = z.join(flat, "geom_id", "left").select(*[c for c in z.columns if c != "geom_id"], *[F.col(f"`{n}`") for n in names])
    return DataCube(out, CubeSchema((Dim("geometry", "geometry"),), crs=zones.schema.crs or cube.schema.crs, kind="vector", geometry=("geometry",)))
