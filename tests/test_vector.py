import json
import math

import pytest
from pyspark.sql import functions as F

from cubespark import errors as E
from cubespark.cube import DataCube
from cubespark.functions import crs
from cubespark.functions import geometry as G
from cubespark.operators.reshape import to_feature_matrix
from cubespark.plans.fixtures import box
from cubespark.registry import ProcessRegistry
from cubespark.schema import CubeSchema, Dim
from cubespark.sources import ParquetCollectionLoader, load_geojson, load_stac, resolve_bands, save_result


def features(spark, rows, kinds, code="EPSG:4326"):
    df = spark.createDataFrame([(*r[:-1], G.from_geojson(r[-1])) for r in rows], f"{kinds}, geometry {G.TYPE}")
    return DataCube(df, CubeSchema((Dim("geometry", "geometry"),), crs=code, kind="vector", geometry=("geometry",)))


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


@pytest.fixture(scope="module")
def cube(spark):
    return features(spark, [(1.0, 2.0, 0, point(10, 50)), (3.0, 4.0, 1, point(10.5, 50.5)), (5.0, 6.0, 0, point(11, 51))], "a double, b double, label int")


def test_bbox_excludes_its_edge(cube):
    assert cube.filter_bbox(west=9, south=49, east=11, north=51).df.count() == 2


def test_feature_matrix(cube):
    m = to_feature_matrix(cube, target_column="label").collect()
    assert len(m) == 3 and list(m[0].features) == [1.0, 2.0]


def test_buffer(spark, cube):
    metres = features(spark, [("p", point(0, 0)), ("q", box(0, 0, 1000, 1000))], "name string", "EPSG:3857")
    out = {r.name: r.geometry for r in metres.vector_buffer(distance=10).df.collect()}
    ring = out["p"].parts[0][0]
    assert len(ring) == 65 and all(math.hypot(p.x, p.y) == pytest.approx(10) for p in ring)
    xs = [p.x for p in out["q"].parts[0][0]]
    assert min(xs) == pytest.approx(-10) and max(xs) == pytest.approx(1010)
    inner = {r.name: r.geometry for r in metres.vector_buffer(distance=-100).df.collect()}
    assert min(p.x for p in inner["q"].parts[0][0]) == pytest.approx(100) and inner["p"].parts == []
    with pytest.raises(ValueError):
        metres.vector_buffer(distance=0)
    with pytest.raises(E.UnitMismatch):
        cube.vector_buffer(distance=1)
    with pytest.raises(E.UnitMismatch):
        features(spark, [("p", point(0, 0))], "name string", None).vector_buffer(distance=1)


def test_circles_are_made_by_more_tasks_than_read_the_points(spark):
    g = F.when(F.col("id") != 7, G.point(F.col("id"), -F.col("id")))
    empty = F.struct(F.lit("Point").alias("type"), F.array().cast(G.TYPE.split("parts:")[1][:-1]).alias("parts"))
    df = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id") == 9, empty).otherwise(g).alias("geometry"), (F.col("id") * 2).alias("twice"))
    c = DataCube(df, CubeSchema((Dim("geometry", "geometry"),), crs="EPSG:3857", kind="vector", geometry=("geometry",)))
    out = c.vector_buffer(distance=10).df
    assert out.columns == df.columns and out.where("geometry.type = 'Polygon'").select(F.spark_partition_id()).distinct().count() == 4
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 400 and all(r.twice == 2 * i for i, r in rows.items())
    assert rows[7].geometry is None and rows[9].geometry.type == "Point" and rows[9].geometry.parts == []
    ring = rows[123].geometry.parts[0][0]
    assert len(ring) == 65 and all(math.hypot(p.x - 123, p.y + 123) == pytest.approx(10) for p in ring)


def test_reproject(cube):
    there = cube.vector_reproject(projection=3857)
    assert there.schema.crs == "EPSG:3857"
    back = there.vector_reproject(projection="EPSG:4326", dimension="geometry").df.collect()
    assert back[0].geometry.parts[0][0][0].x == pytest.approx(10, abs=1e-6)
    with pytest.raises(E.DimensionNotAvailable):
        cube.vector_reproject(projection=3857, dimension="none")
    with pytest.raises(ValueError):
        cube.vector_reproject(projection=2154)


def test_utm():
    # the central meridian of zone 32, and a point known from the series itself and back
    x, y = crs.transform_point(9.0, 0.0, 4326, 32632)
    assert (x, y) == (pytest.approx(500000), pytest.approx(0))
    assert crs.transform_point(*crs.transform_point(11.5, 48.1, 4326, 32632), 32632, 4326) == (pytest.approx(11.5), pytest.approx(48.1))
    assert crs.epsg('PROJCRS["x",ID["EPSG",32632]]') == 32632 and crs.common_epsg([{"properties": {"proj:epsg": 32632}}]) == 32632
    w, s, e, n = crs.transform_bbox((0, 0, 10, 10), 4326, 3857)
    assert e == pytest.approx(1113194.9, abs=0.1) and s == pytest.approx(0, abs=1e-6)


def test_apply_and_filter_vector(cube):
    assert cube.apply(lambda df: df.where("a > 2")).df.count() == 2
    assert cube.apply(lambda p: p.assign(a=p["a"].round() + 1)).df.agg(F.sum("a")).first()[0] == 12
    assert cube.filter_vector(box(9.5, 49.5, 10.7, 50.7)).df.count() == 2 and cube.filter_vector(box(9.5, 49.5, 10.7, 50.7), "disjoint").df.count() == 1
    with pytest.raises(ValueError):
        cube.filter_vector(box(0, 0, 1, 1), "near")


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": point(10, 50), "properties": {"name": "a"}}, {"type": "Feature", "geometry": box(0, 0, 1, 1), "properties": {"name": "b"}}]}
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(doc, indent=1))
    for src in (doc, f"file:{path}"):
        c = load_geojson(spark, src)
        assert c.schema.crs == "EPSG:4326"
        assert {r.name: len(r.geometry.parts[0][0]) for r in c.df.collect()} == {"a": 1, "b": 5}
    assert load_geojson(spark, doc["features"][0], crs=3857).schema.crs == "EPSG:3857"
    assert save_result(load_geojson(spark, doc), f"file:{tmp_path}/out", "GeoJSON")
    lines = [json.loads(r[0]) for r in spark.read.text(f"file:{tmp_path}/out").collect()]
    assert {x["geometry"]["type"] for x in lines} == {"Point", "Polygon"}
    with pytest.raises(ValueError):
        save_result(c, f"file:{tmp_path}/x", "netcdf")
    with pytest.raises(ValueError):
        save_result(c.of(c.df.where("false")), f"file:{tmp_path}/x")


def test_stac(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 2.0)], "y double, x double, value double")
    items = []
    for day in ("2023-01-05", "2023-03-05"):
        df.write.parquet(f"file:{tmp_path}/{day}")
        items.append({"type": "Feature", "properties": {"datetime": f"{day}T00:00:00Z"}, "assets": {"B04": {"href": f"file:{tmp_path}/{day}"}}})
    doc = {"type": "FeatureCollection", "features": items}
    c = load_stac(spark, doc, assets=["red"], temporal_extent=("2023-01", "2023-01"))
    assert c.df.count() == 2 and c.labels("bands") == ["red"]
    with pytest.raises(ValueError):
        load_stac(spark, doc, temporal_extent=("2020", "2021"))
    with pytest.raises(ValueError):
        load_stac(spark, {"type": "Other"})


def test_collections(spark):
    assert resolve_bands(["B04", "B08", "SCL"], ["red", "b08", "SCL"]) == ["B04", "B08", "SCL"] and resolve_bands(["red", "nir"], ["B04"]) == ["red"]
    with pytest.raises(ValueError):
        resolve_bands(["B04"], ["none"])
    with pytest.raises(ValueError):
        ParquetCollectionLoader(spark).load_collection("none")


def test_registry():
    r = ProcessRegistry()
    assert "ndvi" in r.list_processes() and r.get_process("mask")["exceptions"] == ["IncompatibleDataCubes"] and any(s["id"] == "apply_kernel" for s in r.search("KERNEL"))
    with pytest.raises(KeyError):
        r.get_process("none")


def test_hull():
    assert len(G.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])) == 5
    assert G.is_convex([(0, 0), (1, 0), (1, 1)]) and not G.is_convex([(0, 0), (2, 0), (1, 0.2), (1, 2)])


def test_geojson_path_reads_all_features(spark, tmp_path):
    """A path gives the columns, types and rows that the same features give as a dict, wherever a property first occurs."""
    import json

    from cubespark.sources.geojson import load_geojson

    props = [{"b": i, "n": i, "t": True, "none": None, "w": 1.0, "mix": i, "o": {"k": 1}} for i in range(1500)]
    props[1200]["n"] = 2.5
    props[1400] |= {"late": "x", "mix": "y"}
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 1]}, "properties": p} for i, p in enumerate(props)]
    source = {"type": "FeatureCollection", "features": features}
    (tmp_path / "f.geojson").write_text(json.dumps(source))
    got, want = load_geojson(spark, str(tmp_path / "f.geojson")).df, load_geojson(spark, source).df
    assert got.dtypes == want.dtypes and dict(got.dtypes)["n"] == "double" and "late" in got.columns
    rows = lambda df: sorted(map(str, df.drop("o").collect()))  # noqa: E731  (o: the reader's text has other spaces)
    assert rows(got) == rows(want) and got.where("n is null").count() == 0
