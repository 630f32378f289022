import warnings
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from cubespark import errors as E
from cubespark.cube import DataCube
from cubespark.operators import kernel as K
from cubespark.operators.reshape import stack_to_samples, unstack_from_samples
from cubespark.plans.fixtures import box, zones
from cubespark.schema import CubeSchema, Dim

T = [datetime(2023, 1, 31), datetime(2023, 2, 28)]
B = ["red", "nir"]
Y, X = list(np.linspace(50, 51, 4)), list(np.linspace(10, 11, 4))


def cube_of(spark, arr, **axes):
    """A cube with the values of an array; NaN is no-data."""
    roles = {"time": "temporal", "bands": "bands", "latitude": "y", "longitude": "x"}
    axes = {n: [float(x) for x in v] if n not in ("time", "bands") else list(v) for n, v in axes.items()}
    idx = pd.MultiIndex.from_product(axes.values(), names=list(axes))
    pdf = pd.DataFrame({"value": np.asarray(arr, dtype=float).reshape(-1)}, index=idx).reset_index()
    kinds = {"time": "timestamp", "bands": "string"}
    schema = ", ".join(f"{n} {kinds.get(n, 'double')}" for n in axes) + ", value double"
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    df = spark.createDataFrame(rows, schema)
    return DataCube(df, CubeSchema(tuple(Dim(n, roles.get(n, "other"), tuple(v)) for n, v in axes.items()), crs="EPSG:4326"))


def values(cube, *order):
    pdf = cube.df.toPandas().sort_values(list(order))
    return pdf["value"].to_numpy(dtype=float)


@pytest.fixture(scope="module")
def arr():
    return np.random.default_rng(42).random((2, 2, 4, 4))


@pytest.fixture(scope="module")
def cube(spark, arr):
    return cube_of(spark, arr, time=T, bands=B, latitude=Y, longitude=X)


def test_ndvi(cube, arr):
    got = values(cube.ndvi(), "time", "latitude", "longitude")
    r, n = arr[:, 0], arr[:, 1]
    assert np.allclose(got, ((n - r) / (n + r)).reshape(-1))
    more = cube.ndvi(target_band="ndvi")
    assert more.labels("bands") == ["red", "nir", "ndvi"] and more.df.count() == 96


def test_ndvi_no_data_at_zero_and_below(spark):
    c = cube_of(spark, [[0.0, 0.5], [0.4, -1.0]], bands=B, longitude=[0.0, 1.0])
    assert np.isnan(values(c.ndvi(), "longitude")).all()


def test_ndvi_errors(cube):
    with pytest.raises(E.NirBandAmbiguous):
        cube.ndvi(nir="x")
    with pytest.raises(E.RedBandAmbiguous):
        cube.ndvi(red="x")
    with pytest.raises(E.BandExists):
        cube.ndvi(target_band="red")
    with pytest.raises(E.DimensionAmbiguous):
        cube.ndvi(bands_dim="none")


def test_filters(cube):
    assert cube.filter_temporal(extent=("2023-01-01", "2023-01-31")).df.select("time").distinct().count() == 1
    assert cube.filter_temporal(extent=("2023-01", "2023-02")).df.select("time").distinct().count() == 2
    assert cube.filter_bbox(west=10, south=50, east=10.4, north=51).df.select("longitude").distinct().count() == 2
    with pytest.raises(E.DimensionNotAvailable):
        cube.filter_temporal(extent=("2023", "2024"), t_dim="none")


def test_chain(cube):
    out = cube.filter_bbox(west=10, south=50, east=11, north=50.5).ndvi().filter_temporal(extent=("2023-01-01", "2023-01-31"))
    assert out.is_raster and out.df.count() == 8


@pytest.mark.parametrize("name,f", [("mean", np.mean), ("sum", np.sum), ("min", np.min), ("max", np.max), ("median", np.median), ("std", np.std), ("var", np.var), ("prod", np.prod)])
def test_reduce(cube, arr, name, f):
    got = values(cube.reduce_dimension(name, dimension="time"), "bands", "latitude", "longitude")
    assert np.allclose(got, f(arr, axis=0)[::-1].reshape(-1))  # bands in alphabetical order


def test_no_data_policies(spark):
    c = cube_of(spark, [[1.0, np.nan], [3.0, 4.0]], time=T, longitude=[0.0, 1.0])
    got = values(c.reduce_dimension("mean", dimension="time"), "longitude")
    assert got[0] == 2 and np.isnan(got[1])
    assert values(c.reduce_dimension("numpy.nanmean", dimension="time"), "longitude").tolist() == [2, 4]
    assert values(c.reduce_dimension("count", dimension="time"), "longitude").tolist() == [2, 1]
    year = c.aggregate_temporal(period="year", reducer="sum")
    assert values(year, "longitude").tolist() == [4, 4]


def test_reduce_callable_and_errors(cube):
    assert cube.reduce_dimension(lambda v, axis, context: v.max(axis=axis) * context, dimension="bands", context=2).df.count() == 32
    with pytest.raises(ValueError):
        cube.reduce_dimension("nothing", dimension="time")
    with pytest.raises(TypeError):
        cube.reduce_dimension(3, dimension="time")
    with pytest.raises(E.DimensionNotAvailable):
        cube.reduce_dimension("mean", dimension="none")


def test_drop_dimension(cube):
    assert "bands" not in cube.filter_bands(["red"]).drop_dimension(name="bands").schema.names
    with pytest.raises(E.DimensionLabelCountMismatch):
        cube.drop_dimension(name="bands")
    with pytest.raises(E.DimensionNotAvailable):
        cube.drop_dimension(name="none")


def test_periods(spark):
    days = [datetime(2023, 1, 5), datetime(2023, 1, 15), datetime(2023, 1, 25), datetime(2023, 2, 8), datetime(2023, 12, 15), datetime(2023, 12, 25)]
    c = cube_of(spark, np.arange(6.0), time=days)
    labels = lambda p, **k: sorted(r[0] for r in c.aggregate_temporal(period=p, **k).df.select("time").collect())
    assert labels("dekad") == [f"2023-{i:02d}" for i in (1, 2, 3, 4, 35, 36)]
    assert labels("month") == [f"2023-{i:02d}" for i in range(1, 13)]
    assert labels("season") == ["2023-djf", "2023-jja", "2023-mam", "2023-son", "2024-djf"]
    assert labels("tropical-season") == ["2022-ndjfma", "2023-ndjfma"]
    assert labels("decade") == ["2020"] and labels("decade-ad") == ["2021"]
    week = cube_of(spark, [1.0, 2.0], time=[datetime(2021, 1, 3), datetime(2021, 1, 4)]).aggregate_temporal(period="week")
    assert sorted(r[0] for r in week.df.select("time").collect()) == ["2020-53", "2021-01"]
    with pytest.raises(ValueError):
        c.aggregate_temporal(period="fortnight")
    with pytest.raises(TypeError):
        c.aggregate_temporal(period="month").aggregate_temporal(period="year")


@pytest.mark.parametrize("border,mode", [(0, "constant"), ("replicate", "edge"), ("reflect", "symmetric"), ("reflect_pixel", "reflect"), ("wrap", "wrap"), (2.5, "constant")])
def test_kernel(spark, border, mode):
    a = np.random.default_rng(1).random((5, 6))
    k = np.arange(15.0).reshape(3, 5)
    c = cube_of(spark, a, latitude=range(5), longitude=range(6))
    more = {"constant_values": border} if mode == "constant" else {}
    p = np.pad(a, ((1, 1), (2, 2)), mode=mode, **more)
    want = [[(p[y : y + 3, x : x + 5] * k[::-1, ::-1]).sum() * 0.5 for x in range(6)] for y in range(5)]
    got = values(c.apply_kernel(kernel=k.tolist(), factor=0.5, border=border), "latitude", "longitude")
    assert np.allclose(got, np.ravel(want))


def test_kernel_errors(cube):
    for k in ([[1, 2], [3, 4]], [[1, 2, 3], [4, 5, 6]], [[1, 2], [3, 4], [5, 6]]):
        with pytest.raises(E.KernelDimensionsUneven):
            cube.apply_kernel(kernel=k)
    with pytest.raises(ValueError):
        cube.apply_kernel(kernel=[[1]], border="mirror")
    assert K.border_index(-1, 1, "reflect_pixel") == 0


def test_interpolate(spark):
    c = cube_of(spark, [1, np.nan, 3, np.nan, 5], item=[0.0, 1.0, 2.0, 3.0, 4.0])
    assert values(c.array_interpolate_linear(dimension="item"), "item").tolist() == [1, 2, 3, 4, 5]
    c = cube_of(spark, [np.nan, 2, np.nan, 8, np.nan], bands=list("edcba"))
    got = c.array_interpolate_linear(dimension="bands").df.toPandas().set_index("bands")["value"]
    assert got["c"] == 5 and np.isnan(got["e"]) and np.isnan(got["a"])
    with pytest.raises(ValueError):
        c.array_interpolate_linear()
    with pytest.raises(E.DimensionNotAvailable):
        c.array_interpolate_linear(dimension="none")


def test_mask(spark, cube, arr):
    m = np.zeros((2, 2, 4, 4))
    m[0, 0, 0, 0] = 1
    out = cube.mask(cube_of(spark, m, time=T, bands=B, latitude=Y, longitude=X), replacement=-5.0)
    got = out.df.where("value = -5").collect()
    assert len(got) == 1 and got[0].bands == "red"
    far = cube_of(spark, np.zeros((4, 4)), latitude=[v + 0.1 for v in Y], longitude=X)
    assert out.df.sparkSession is spark and cube.mask(far).df.where("value is null").select("latitude").distinct().count() == 1
    with pytest.raises(E.IncompatibleDataCubes):
        cube.mask(cube_of(spark, np.zeros((2, 4, 4)), bands=["a", "b"], latitude=Y, longitude=X))
    with pytest.raises(E.IncompatibleDataCubes):
        cube.mask(cube_of(spark, [0.0], other=[1.0]))


def test_mask_polygon(spark):
    a = np.ones((5, 5))
    a[2, 2] = np.nan
    c = cube_of(spark, a, latitude=np.linspace(50, 51, 5), longitude=np.linspace(10, 11, 5))
    square = box(10.2, 50.2, 10.8, 50.8)
    assert c.mask_polygon(square, replacement=9.0).df.where("value = 9").count() == 16
    inside = c.mask_polygon({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": square}, {"type": "Feature", "geometry": None}]}, replacement=9.0, inside=True)
    assert inside.df.where("value = 9").count() == 8 and inside.df.where("value is null").count() == 1
    with pytest.raises(TypeError):
        c.mask_polygon({"type": "Point", "coordinates": [0, 0]})
    with pytest.raises(TypeError):
        c.mask_polygon(3)
    with pytest.raises(E.DimensionNotAvailable):
        c.mask_polygon(square, x_dim="x")


def test_clouds(spark):
    qa = np.array([[3 << 8, 2 << 8], [3 << 10, 0]], dtype=float)
    c = cube_of(spark, qa[None], bands=["QA_PIXEL"], latitude=[0.0, 1.0], longitude=[0.0, 1.0])
    got = c.cloud_detection().df.toPandas().set_index(["bands", "latitude", "longitude"])["value"]
    assert got["cloud", 0, 0] == 1 and got["cloud", 0, 1] == pytest.approx(2 / 3) and got["shadow", 1, 0] == 1 and got["shadow", 1, 1] == 0
    assert c.cloud_detection(options={"include_shadow": False}).labels("bands") == ["cloud"]
    with pytest.raises(ValueError):
        c.cloud_detection(method="Sen2Cor")
    with pytest.raises(ValueError):
        c.cloud_detection(method="other")
    s2 = cube_of(spark, np.zeros((10, 2, 2)), bands=["B01", "B02", "B04", "B05", "B08", "B8A", "B09", "B10", "B11", "B12"], latitude=[0, 1], longitude=[0, 1])
    with pytest.raises(ImportError):
        s2.cloud_detection()
    with pytest.raises(ValueError):
        cube_of(spark, np.zeros((1, 2, 2)), bands=["SR_B1"], latitude=[0, 1], longitude=[0, 1]).cloud_detection()


def test_resample(spark):
    a = np.arange(64.0).reshape(8, 8)
    c = cube_of(spark, a, latitude=np.arange(8)[::-1].astype(float), longitude=np.arange(8.0))
    assert c.resample_spatial() is c
    got = c.resample_spatial(resolution=2, method="average").df.toPandas().pivot(index="latitude", columns="longitude", values="value").sort_index(ascending=False)
    assert np.allclose(got, a.reshape(4, 2, 4, 2).mean(axis=(1, 3)))
    for m in ("bilinear", "cubic", "cubicspline", "lanczos"):
        same = c.resample_spatial(resolution=1, method=m).df.toPandas().pivot(index="latitude", columns="longitude", values="value").sort_index(ascending=False)
        assert same.shape == (8, 8) and (m == "cubicspline" or np.allclose(same, a))
    with pytest.raises(ValueError):
        c.resample_spatial(resolution=2, method="none")
    assert c.resample_spatial(projection=3857, resolution=200_000, method="average").schema.crs == "EPSG:3857"


def test_zonal(spark):
    a = np.random.default_rng(3).random((2, 10, 10))
    c = cube_of(spark, a, bands=B, latitude=np.arange(10.0), longitude=np.arange(10.0))
    got = c.aggregate_spatial(zones(spark), "mean").df.toPandas().set_index("zone")
    assert got.loc["a", "red"] == pytest.approx(a[0, 1:4, 1:4].mean()) and got.loc["b", "nir"] == pytest.approx(a[1, 2:6, 3:8].mean())
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        c.aggregate_spatial(zones(spark), "nothing")
    assert any(issubclass(x.category, UserWarning) for x in w)
    with pytest.raises(ValueError):
        c.aggregate_spatial(None, "nothing")


def test_samples(cube):
    df, names = stack_to_samples(cube, ["bands", "time"])
    assert len(names) == 4 and names[0].startswith("red") and df.count() == 16
    assert unstack_from_samples(df.selectExpr("latitude", "longitude", "features[0] AS value"), cube, ["bands", "time"]).schema.names == ["latitude", "longitude"]
    with pytest.raises(ValueError):
        stack_to_samples(cube, [])


def test_kinds(spark, cube):
    with pytest.raises(TypeError):
        cube.vector_buffer(distance=1)
    with pytest.raises(TypeError):
        zones(spark).ndvi()
    assert "raster" in repr(cube) and cube.compute().df.count() == 64
    lonely = cube.of(cube.df.where("value > 0.5"))
    assert lonely.densify().df.count() == 64
