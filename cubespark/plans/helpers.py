"""Queries of sources, sinks, checks and helpers, beside SQL for the same rows."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cube import DataCube
from ..errors import IncompatibleDataCubes
from ..functions import crs, scalar
from ..operators import reshape
from ..operators.clouds import detect_method
from ..schema import CubeSchema, Dim
from ..sources import ParquetCollectionLoader, load_collection, load_stac, save_result
from . import fixtures as X
from .queries import ALL, C1, C2, PIX, add, flat, sql


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine a temporary one, removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return f"{base.rstrip('/')}/cubespark/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="cubespark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file:{path}"


def outcome(f) -> str:
    """The name of the error that a call ends in, or ``none``."""
    try:
        f()
    except (TypeError, ValueError, KeyError) as e:
        return type(e).__name__
    return "none"


# sources and sinks

_MERCATOR = """longitude BETWEEN degrees(60000 / 6378137.0::DOUBLE) AND degrees(360000 / 6378137.0::DOUBLE) AND
latitude BETWEEN degrees(2 * atan(exp(60000 / 6378137.0::DOUBLE)) - pi() / 2) AND degrees(2 * atan(exp(360000 / 6378137.0::DOUBLE)) - pi() / 2)"""


@add("s05_bbox_in_metres", sql(f"SELECT * FROM c1 WHERE {_MERCATOR}", *ALL, cte=C1))
def s05(spark, d):
    loader = ParquetCollectionLoader(spark, tables={"events": lambda: X.events_cube(spark, d).df})
    return flat(load_collection("events", adapter=loader, spatial_extent={"west": 60000, "south": 60000, "east": 360000, "north": 360000, "crs": 3857}))


@add("s05_common_epsg", "SELECT * FROM (VALUES ('same', 32632), ('mixed', 4326), ('none', 4326), ('some', 3857)) AS t(items, code)")
def s05c(spark, d):
    items = {
        "same": [{"properties": {"proj:code": "EPSG:32632"}}, {"properties": {"proj:epsg": 32632}}],
        "mixed": [{"properties": {"proj:epsg": 32632}}, {"properties": {"proj:epsg": 32633}}],
        "none": [{"properties": {}}],
        "some": [{"properties": {"proj:epsg": 3857}}, {}],
    }
    return spark.createDataFrame([(k, crs.common_epsg(v)) for k, v in items.items()], "items string, code int")


_BANDS = ("view", "click", "error")


def _saved_items(spark: SparkSession, d: str) -> dict:
    """The cube saved as a table for each band, and two items that name them: of the 1st and of the 20th."""
    path, cube = folder(spark), X.events_cube(spark, d)
    mean = cube.of(cube.df.groupBy("bands", "latitude", "longitude").agg(F.avg("value").alias("value")), cube.schema.without("time"))
    save_result(mean, f"{path}/cells", partition_by=["bands"], mode="overwrite")
    item = lambda day: {"type": "Feature", "properties": {"datetime": f"2024-01-{day}T00:00:00Z"}, "assets": {b: {"href": f"{path}/cells/bands={b}"} for b in X.EVENT_BANDS}}
    return {"type": "FeatureCollection", "features": [item("01"), item("20")]}


_MEAN = "SELECT bands, latitude, longitude, avg(value) AS value FROM c1 GROUP BY ALL"


@add("s06_load_stac", sql(f"SELECT t.time, m.* FROM ({_MEAN}) m, (VALUES (TIMESTAMP '2024-01-01'), (TIMESTAMP '2024-01-20')) AS t(time) WHERE bands IN {_BANDS} AND longitude BETWEEN 1 AND 3 AND latitude BETWEEN 0 AND 2", *ALL, cte=C1))
def s06(spark, d):
    return flat(load_stac(spark, _saved_items(spark, d), assets=list(_BANDS), spatial_extent={"west": 1, "south": 0, "east": 3, "north": 2}))


@add("s07_items_of_a_catalogue", sql(f"SELECT TIMESTAMP '2024-01-20' AS time, m.* FROM ({_MEAN}) m WHERE bands IN {_BANDS}", *ALL, cte=C1))
def s07(spark, d):
    """A catalogue links to the document, which is a file; the interval leaves one item."""
    path = folder(spark)
    spark.createDataFrame([(json.dumps(_saved_items(spark, d)),)], "value string").write.mode("overwrite").text(f"{path}/items")
    catalogue = {"type": "Catalog", "links": [{"rel": "self", "href": "nowhere"}, {"rel": "item", "href": f"{path}/items"}]}
    return flat(load_stac(spark, catalogue, assets=list(_BANDS), temporal_extent=("2024-01-10", "2024-01-31")))


@add("s09_zones_of_a_file", sql(" UNION ALL ".join(f"SELECT '{z}' AS zone, bands, value FROM c2 WHERE {c}" for z, c in X.ZONE_SQL.items()).join(("SELECT zone, bands, avg(value) AS value FROM (", ") GROUP BY ALL")), "zone", "bands", cte=C2))
def s09(spark, d):
    path = folder(spark)
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"zone": z}} for z, g in X.ZONES.items()]}
    spark.createDataFrame([(json.dumps(doc),)], "value string").write.mode("overwrite").text(f"{path}/zones")
    cube = X.lineitem_cube(spark, d)
    cube = cube.of(cube.df.drop("time"), cube.schema.without("time"))
    wide = cube.aggregate_spatial(f"{path}/zones", "mean").df
    return flat(wide.unpivot(["zone"], list(X.MEASURES), "bands", "value"))


for _format in ("parquet", "orc", "json"):

    @add(f"s11_save_{_format}", sql("SELECT * FROM c1", *ALL, cte=C1))
    def s11(spark, d, format=_format):
        path, cube = folder(spark), X.events_cube(spark, d)
        save_result(cube, f"{path}/cube", format.upper(), mode="overwrite")
        return flat(spark.read.schema(cube.df.schema).format(format).load(f"{path}/cube"))


@add("s11_save_geojson", f"SELECT c_custkey, (round(c_acctbal + 1e-9, 6) + 0.0) AS c_acctbal, (round(x + 1e-9, 6) + 0.0) AS x, (round(y + 1e-9, 6) + 0.0) AS y FROM ({X.POINTS})")
def s11g(spark, d):
    path = folder(spark)
    save_result(X.customer_points(spark, d), f"{path}/points", "geojson", mode="overwrite")
    lines = spark.read.text(f"{path}/points")
    at = lambda p, kind: F.get_json_object("value", f"$.{p}").cast(kind)
    return flat(lines.select(at("properties.c_custkey", "long").alias("c_custkey"), at("properties.c_acctbal", "double").alias("c_acctbal"), at("geometry.coordinates[0]", "double").alias("x"), at("geometry.coordinates[1]", "double").alias("y")))


@add("s12_compute", sql("SELECT time, bands, latitude, longitude, value + 1 AS value FROM c1", *ALL, cte=C1))
def s12(spark, d):
    return flat(X.events_cube(spark, d).apply(lambda v: v + 1).compute())


class _Half:
    """A loader of one's own, for collections and items alike."""

    def __init__(self, spark: SparkSession, d: str):
        self.cube = X.events_cube(spark, d).apply(lambda v: v / 2)

    def load_collection(self, collection_id, *, spatial_extent=None, temporal_extent=None, bands=None, properties=None, **kwargs):
        return self.cube.filter_bands(bands)

    def load_stac(self, spark, source, *, assets=None, spatial_extent=None, temporal_extent=None, **kwargs):
        return self.cube.filter_bands(assets)


@add("u06_adapters", sql("SELECT time, bands, latitude, longitude, value / 2 AS value FROM c1 WHERE bands IN ('view', 'error')", *ALL, cte=C1))
def u06(spark, d):
    own = _Half(spark, d)
    a, b = load_collection("any", adapter=own, bands=["view"]), load_stac(spark, "any", adapter=own, assets=["error"])
    return flat(a.df.unionByName(b.df))


# checks


@add("r08_mask_dimensions", "SELECT * FROM (VALUES ('same', 'none'), ('other dimension', 'IncompatibleDataCubes'), ('other labels', 'IncompatibleDataCubes')) AS t(mask, error)")
def r08(spark, d):
    cube = X.events_cube(spark, d)
    grid = lambda *dims: DataCube(spark.createDataFrame([(*["view" if n == "bands" else 0.0 for n in dims], 1.0)], ", ".join(f"{n} {'string' if n == 'bands' else 'double'}" for n in dims) + ", value double"), CubeSchema(tuple(Dim(n) for n in dims)))
    masks = {"same": grid("latitude", "longitude"), "other dimension": grid("latitude", "height"), "other labels": grid("bands")}

    def error(m):
        try:
            cube.mask(m)
        except IncompatibleDataCubes as e:
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(k, error(m)) for k, m in masks.items()], "mask string, error string")


@add("r13_cloud_method", "SELECT * FROM (VALUES ('quality', 'Fmask'), ('sentinel', 's2cloudless'), ('landsat', 'ValueError'), ('few', 'ValueError')) AS t(bands, method)")
def r13(spark, d):
    sets = {"quality": ["SR_B4", "QA_PIXEL"], "sentinel": ["B01", "B02", "B04", "B05", "B08", "B8A"], "landsat": ["SR_B4", "SR_B5"], "few": ["B01", "B02"]}
    rows = [(k, v if (v := outcome(lambda b=b: detect_method(b))) != "none" else detect_method(b)) for k, b in sets.items()]
    return spark.createDataFrame(rows, "bands string, method string")


@add("u08_kinds", "SELECT * FROM (VALUES ('raster', 'vector_buffer', 'TypeError'), ('raster', 'ndvi', 'none'), ('vector', 'ndvi', 'TypeError'), ('vector', 'filter_bbox', 'none')) AS t(kind, operator, error)")
def u08(spark, d):
    raster, vector = X.events_cube(spark, d), X.customer_points(spark, d)
    calls = [(raster, "vector_buffer", {"distance": 1}), (raster, "ndvi", {"nir": "view", "red": "click"}), (vector, "ndvi", {}), (vector, "filter_bbox", {"west": 0, "south": 0, "east": 1, "north": 1})]
    rows = [("raster" if c.is_raster else "vector", name, outcome(lambda c=c, name=name, more=more: getattr(c, name)(**more))) for c, name, more in calls]
    return spark.createDataFrame(rows, "kind string, operator string, error string")


# reshaping and helpers


@add("h02_unstack_samples", sql("SELECT time, latitude, longitude, sum(value) AS value FROM c1 GROUP BY ALL", *PIX, cte=C1))
def h02(spark, d):
    cube = X.events_cube(spark, d)
    samples, _ = reshape.stack_to_samples(cube, "bands")
    total = samples.withColumn("value", F.aggregate(F.filter("features", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v))
    return flat(reshape.unstack_from_samples(total, cube, "bands"))


@add("h07_rename_dimension", sql("SELECT time, bands AS kind, latitude, longitude, value FROM c1", "time", "kind", "latitude", "longitude", cte=C1))
def h07(spark, d):
    return flat(reshape.rename_dimension(X.events_cube(spark, d), "bands", "kind"))


@add("f06_plain_values", "SELECT * FROM (VALUES ('scalar', '2.5'), ('array', '[1, 2]'), ('tuple', '[1, None]'), ('text', 'TypeError'), ('matrix', 'TypeError')) AS t(given, plain)")
def f06(spark, d):
    import numpy as np

    given = {"array": np.array([1, 2]), "tuple": (1, None), "text": "ab", "matrix": np.zeros((2, 2))}
    rows = [("scalar", str(scalar.plain(np.float32(2.5))))]
    rows += [(k, e if (e := outcome(lambda v=v: scalar.as_list(v))) != "none" else str(scalar.as_list(v))) for k, v in given.items()]
    return spark.createDataFrame(rows, "given string, plain string")


@add("v06_coordinate_systems", """SELECT * FROM (VALUES ('32632', 32632, 'none'), ('EPSG:4326', 4326, 'UnitMismatch'), ('PROJCRS["x",ID["EPSG",3857]]', 3857, 'none')) AS t(crs, code, metres)""")
def v06(spark, d):
    def metres(c):
        try:
            crs.assert_metres(c)
        except crs.UnitMismatch as e:
            return type(e).__name__
        return "none"

    names = ["32632", "EPSG:4326", 'PROJCRS["x",ID["EPSG",3857]]']
    return spark.createDataFrame([(c, crs.epsg(c), metres(c)) for c in names], "crs string, code int, metres string")

