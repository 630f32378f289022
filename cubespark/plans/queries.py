"""A query for each operator, over whole tables, beside SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions import periods, scalar
from ..operators import reshape
from ..operators.zonal import zone_values
from ..registry import ProcessRegistry
from ..schema import CubeSchema, Dim
from ..sources import ParquetCollectionLoader, load_collection, load_geojson, resolve_bands
from ..sources.collection import COMMON_NAMES
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def rounded(c, digits: int = 6):
    """Off exact ties, which engines round differently, and without a negative zero."""
    return F.round(c + 1e-9, digits) + 0.0


def flat(cube: DataCube | DataFrame, digits: int = 6) -> DataFrame:
    """Times as texts, doubles rounded: what two engines can agree on."""
    df = cube.df if isinstance(cube, DataCube) else cube
    cols = []
    for n, k in df.dtypes:
        c = F.col(f"`{n}`")
        if k.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif k == "double":
            c = rounded(c, digits)
        cols.append(c.alias(n))
    return df.select(*cols)


def sql(body: str, *names: str, time: bool = True, cte: str = "", value: str = "value", digits: int = 6) -> str:
    t = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"
    cols = ", ".join(t if n == "time" and time else n for n in names)
    return f"{'WITH ' + cte if cte else ''} SELECT {cols + ', ' if cols else ''}round({value} + 1e-9, {digits}) + 0.0 AS {value} FROM ({body})"


C1 = f"c1 AS ({X.EVENTS.format(unit='day')})"
C2 = f"c2 AS ({X.LINEITEM})"
C3 = f"c3 AS ({X.EMBEDDING})"
QA = f"qa AS ({X.QUALITY})"
D1 = f"""{C1}, d1 AS (SELECT t.time, b.bands, y.latitude, x.longitude, c1.value FROM (SELECT DISTINCT time FROM c1) t,
(SELECT unnest({list(X.EVENT_BANDS)}) AS bands) b, (SELECT DISTINCT latitude FROM c1) y, (SELECT DISTINCT longitude FROM c1) x
LEFT JOIN c1 ON c1.time = t.time AND c1.bands = b.bands AND c1.latitude = y.latitude AND c1.longitude = x.longitude)"""
ALL = ("time", "bands", "latitude", "longitude")
PIX = ("time", "latitude", "longitude")


def _ndvi_sql(src: str, nir: str, red: str) -> str:
    of = lambda b: f"max(CASE WHEN bands = '{b}' AND value > 0 THEN value END)"
    return f"""SELECT time, latitude, longitude, CASE WHEN n IS NOT NULL AND r IS NOT NULL THEN greatest(-1, least(1, (n - r) / (n + r))) END AS value FROM (SELECT time, latitude, longitude,
{of(nir)} AS n, {of(red)} AS r FROM {src} WHERE bands IN ('{nir}', '{red}') GROUP BY ALL)"""


# sources


def _collection(spark, d):
    return ParquetCollectionLoader(spark, tables={"events": lambda: X.events_cube(spark, d).df})


@add("s01_load_collection", sql("SELECT * FROM c1 WHERE longitude BETWEEN 1 AND 3 AND latitude BETWEEN 0 AND 2 AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-21' AND bands IN ('view', 'click') AND value < 400", *ALL, cte=C1))
def s01(spark, d):
    return flat(load_collection("events", adapter=_collection(spark, d), spatial_extent={"west": 1, "south": 0, "east": 3, "north": 2}, temporal_extent=("2024-01-05", "2024-01-20"), bands=["view", "click"], properties={"value": {"lt": 400}}))


@add("s03_load_collection_aliases", sql("SELECT time, upper(bands) AS bands, latitude, longitude, value FROM c1 WHERE bands IN ('view', 'error')", *ALL, cte=C1))
def s03(spark, d):
    return flat(load_collection("events", adapter=_collection(spark, d), bands=["VIEW", "ERROR"]))


@add("s04_band_alias", "SELECT * FROM (VALUES ('red', 'B04'), ('NIR', 'B08'), ('b02', 'B02'), ('scl', 'SCL')) AS t(band, key)")
def s04(spark, d):
    asked = ["red", "NIR", "b02", "scl"]
    return spark.createDataFrame(list(zip(asked, resolve_bands(list(COMMON_NAMES.values()), asked), strict=True)), "band string, key string")


@add("s08_load_geojson", "SELECT * FROM (VALUES ('p1', 3, 10.0::DOUBLE, 50.0::DOUBLE), ('p2', 4, 11.0::DOUBLE, 51.0::DOUBLE)) AS t(name, n, x, y)".replace("3,", "3::BIGINT,").replace("4,", "4::BIGINT,"))
def s08(spark, d):
    f = lambda name, n, x, y: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"name": name, "n": n}}
    cube = load_geojson(spark, {"type": "FeatureCollection", "features": [f("p1", 3, 10, 50), f("p2", 4, 11, 51)]})
    p = F.col("geometry.parts")[0][0][0]
    return cube.df.select("name", "n", p["x"].alias("x"), p["y"].alias("y"))


# filters and indices


@add("r01_ndvi_drop", sql(_ndvi_sql("c1", "view", "click"), *PIX, cte=C1))
def r01a(spark, d):
    return flat(X.events_cube(spark, d).ndvi(nir="view", red="click"))


@add("r01_ndvi_append", sql(f"SELECT * FROM c1 UNION ALL SELECT time, 'ndvi', latitude, longitude, value FROM ({_ndvi_sql('c1', 'view', 'click')})", *ALL, cte=C1))
def r01b(spark, d):
    return flat(X.events_cube(spark, d).ndvi(nir="view", red="click", target_band="ndvi"))


@add("r01_ndvi_lineitem", sql(_ndvi_sql("c2", "discount", "tax"), *PIX, cte=C2))
def r01c(spark, d):
    return flat(X.lineitem_cube(spark, d).ndvi(nir="discount", red="tax"))


@add("r02_filter_bbox", sql("SELECT * FROM c1 WHERE longitude BETWEEN 1 AND 3 AND latitude BETWEEN 2 AND 4", *ALL, cte=C1))
def r02(spark, d):
    return flat(X.events_cube(spark, d).filter_bbox(west=1, south=2, east=3, north=4))


@add("r03_filter_temporal_closed", sql("SELECT * FROM c1 WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-16'", *ALL, cte=C1))
def r03(spark, d):
    return flat(X.events_cube(spark, d).filter_temporal(extent=("2024-01-10", "2024-01-15")))


@add("r04_filter_bands", sql("SELECT * FROM c1 WHERE bands IN ('error', 'view')", *ALL, cte=C1))
def r04(spark, d):
    return flat(X.events_cube(spark, d).filter_bands(["view", "error"]))


@add("r05_drop_dimension", sql("SELECT time, latitude, longitude, value FROM c1 WHERE bands = 'view'", *PIX, cte=C1))
def r05(spark, d):
    return flat(X.events_cube(spark, d).filter_bands(["view"]).drop_dimension(name="bands"))


@add("r06_apply_linear", sql("SELECT time, bands, latitude, longitude, value * 2 + 1 AS value FROM c1", *ALL, cte=C1))
def r06a(spark, d):
    return flat(X.events_cube(spark, d).apply(lambda v: v * 2 + 1))


@add("r06_apply_context", sql("SELECT time, bands, latitude, longitude, value - 100 AS value FROM c1", *ALL, cte=C1))
def r06b(spark, d):
    return flat(X.events_cube(spark, d).apply(lambda v, context: v - context["less"], context={"less": 100}))


@add("r06_apply_arrays", sql("SELECT time, bands, latitude, longitude, sqrt(value) AS value FROM c1", *ALL, cte=C1))
def r06c(spark, d):
    import numpy as np

    return flat(X.events_cube(spark, d).apply(np.sqrt))


# masks


def _above(cube: DataCube, dims: list[str], limit: float) -> DataCube:
    """A mask: 1 where the mean over the dimensions left out is over a limit."""
    df = cube.df.groupBy(*dims).agg(F.when(F.avg("value") > limit, 1.0).otherwise(0.0).alias("value"))
    return DataCube(df, CubeSchema(tuple(d for d in cube.schema.dims if d.name in dims)))


@add("r07_mask_numeric", sql("SELECT time, bands, latitude, longitude, CASE WHEN value > 120 THEN NULL ELSE value END AS value FROM c1", *ALL, cte=C1))
def r07a(spark, d):
    c = X.events_cube(spark, d)
    return flat(c.mask(_above(c, list(ALL), 120)))


_PIXEL_MASK = "m AS (SELECT latitude, longitude, avg(value) > 105 AS hit FROM c1 GROUP BY ALL)"


@add("r07_mask_broadcast", sql("SELECT time, bands, c1.latitude, c1.longitude, CASE WHEN hit THEN NULL ELSE value END AS value FROM c1 JOIN m ON c1.latitude = m.latitude AND c1.longitude = m.longitude", *ALL, cte=f"{C1}, {_PIXEL_MASK}"))
def r07b(spark, d):
    c = X.events_cube(spark, d)
    m = _above(c, ["latitude", "longitude"], 105)
    return flat(c.mask(DataCube(m.df.withColumn("value", F.col("value") > 0), m.schema)))


@add("r07_mask_replacement", sql("SELECT time, bands, c1.latitude, c1.longitude, CASE WHEN hit THEN -1 ELSE value END AS value FROM c1 JOIN m ON c1.latitude = m.latitude AND c1.longitude = m.longitude", *ALL, cte=f"{C1}, {_PIXEL_MASK}"))
def r07c(spark, d):
    c = X.events_cube(spark, d)
    return flat(c.mask(_above(c, ["latitude", "longitude"], 105), replacement=-1.0))


@add("r09_mask_nearest", sql("""SELECT time, bands, latitude, longitude, CASE WHEN latitude > 3.3 OR longitude > 3.3 OR
(CASE WHEN latitude <= 1.6 THEN 0 ELSE 1 END + CASE WHEN longitude <= 1.6 THEN 0 ELSE 1 END) % 2 = 1 THEN NULL ELSE value END AS value FROM c1""", *ALL, cte=C1))
def r09(spark, d):
    c = X.events_cube(spark, d)
    rows = [(y, x, float((i + j) % 2)) for i, y in enumerate((0.0, 3.3)) for j, x in enumerate((0.0, 3.3))]
    m = spark.createDataFrame(rows, "latitude double, longitude double, value double")
    return flat(c.mask(DataCube(m, CubeSchema((Dim("latitude", "y"), Dim("longitude", "x"))))))


for _inside in (False, True):
    _name = "inside" if _inside else "outside"

    @add(f"r10_mask_polygon_{_name}", sql(f"SELECT time, bands, latitude, longitude, CASE WHEN {'' if _inside else 'NOT'} ({X.ZONE_SQL['t']}) THEN NULL ELSE value END AS value FROM c2", *ALL, cte=C2))
    def r10(spark, d, inside=_inside):
        return flat(X.lineitem_cube(spark, d).mask_polygon(X.ZONES["t"], inside=inside))


for _shadow in (True, False):
    _bits = [("cloud", 8)] + ([("shadow", 10)] if _shadow else [])
    _body = " UNION ALL ".join(f"SELECT time, '{n}' AS bands, latitude, longitude, ((qa >> {b}) & 3) / 3.0::DOUBLE AS value FROM qa" for n, b in _bits)

    @add(f"r14_fmask_{'shadow' if _shadow else 'no_shadow'}", sql(_body, *ALL, cte=QA))
    def r14(spark, d, shadow=_shadow):
        return flat(X.quality_cube(spark, d).cloud_detection(options={"include_shadow": shadow}))


# aggregation

SKIP = {"mean": "avg(value)", "sum": "coalesce(sum(value), 0)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "std": "stddev_pop(value)", "var": "var_pop(value)", "count": "CAST(count(value) AS DOUBLE)"}

for _r in ("mean", "median", "std", "sum"):

    @add(f"a01_spatial_{_r}", sql(f"SELECT time, bands, {SKIP[_r]} AS value FROM c1 GROUP BY ALL", "time", "bands", cte=C1))
    def a01(spark, d, r=_r):
        return flat(X.events_cube(spark, d).aggregate_spatial(None, r))


_IN_ZONES = " UNION ALL ".join(f"SELECT '{z}' AS zone, * FROM c2 WHERE {c}" for z, c in X.ZONE_SQL.items())

for _r in ("mean", "sum", "min", "max", "median"):

    @add(f"a02_zonal_{_r}", sql(f"SELECT zone, bands, time, {SKIP[_r]} AS value FROM ({_IN_ZONES}) GROUP BY ALL", "zone", "bands", "time", cte=C2))
    def a02(spark, d, r=_r):
        z = X.zones(spark)
        got = zone_values(X.lineitem_cube(spark, d), z, r, "longitude", "latitude")
        return flat(got.join(z.df.select("geom_id", "zone"), "geom_id").select("zone", "bands", "time", "value"))


_YEARS = range(1995, 2002)
_WIDE = ", ".join(f"round(avg(value) FILTER (bands = '{b}' AND year(time) = {y}) + 1e-9, 6) + 0.0 AS {b}_{y}" for y in _YEARS for b in ("quantity", "tax"))


@add("a02_zonal_wide", f"""WITH {C2}, y AS (SELECT date_trunc('year', time) AS time, bands, latitude, longitude, avg(value) AS value FROM c2 GROUP BY ALL)
SELECT zone, {_WIDE} FROM ({_IN_ZONES.replace("FROM c2", "FROM y")}) GROUP BY zone""")
def a02w(spark, d):
    c = X.lineitem_cube(spark, d).filter_bands(["quantity", "tax"]).aggregate_temporal(period="year")
    c = c.with_labels("time", [str(y) for y in _YEARS])
    return flat(c.aggregate_spatial(X.zones(spark), "mean").df.drop("geometry"))


_SEASON = """CASE WHEN month(time) = 12 THEN year(time) + 1 ELSE year(time) END || '-' || CASE WHEN month(time) IN (12, 1, 2) THEN 'djf'
WHEN month(time) IN (3, 4, 5) THEN 'mam' WHEN month(time) IN (6, 7, 8) THEN 'jja' ELSE 'son' END"""
LABEL = {
    "hour": "strftime(time, '%Y-%m-%d-%H')",
    "day": "strftime(time, '%Y-%j')",
    "week": "strftime(time, '%G-%V')",
    "dekad": "year(time) || '-' || lpad(CAST((month(time) - 1) * 3 + CASE WHEN day(time) <= 10 THEN 1 WHEN day(time) <= 20 THEN 2 ELSE 3 END AS VARCHAR), 2, '0')",
    "month": "strftime(time, '%Y-%m')",
    "season": _SEASON,
    "tropical-season": "(CASE WHEN month(time) <= 4 THEN year(time) - 1 ELSE year(time) END) || '-' || CASE WHEN month(time) IN (11, 12, 1, 2, 3, 4) THEN 'ndjfma' ELSE 'mjjaso' END",
    "year": "CAST(year(time) AS VARCHAR)",
    "decade": "CAST(CAST(floor(year(time) / 10) * 10 AS BIGINT) AS VARCHAR)",
    "decade-ad": "CAST(CAST(floor((year(time) - 1) / 10) * 10 + 1 AS BIGINT) AS VARCHAR)",
}

for _p, _l in LABEL.items():
    _source, _cte = ("c1", C1) if _p in ("hour", "day", "week", "dekad") else ("c2", C2)

    @add(f"a03_temporal_{_p.replace('-', '_')}", sql(f"SELECT {_l} AS time, bands, latitude, longitude, avg(value) AS value FROM {_source} GROUP BY ALL", *ALL, time=False, cte=_cte))
    def a03(spark, d, p=_p, source=_source):
        cube = X.events_cube(spark, d) if source == "c1" else X.lineitem_cube(spark, d)
        return flat(cube.aggregate_temporal(period=p, fill_gaps=False))


@add("a03_gapfill_hour", f"""SELECT strftime(h, '%Y-%m-%d-%H') AS time, (round(value + 1e-9, 6) + 0.0) AS value FROM
(SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS h)
LEFT JOIN (SELECT date_trunc('hour', ts) AS h2, avg(value) AS value FROM events GROUP BY ALL) ON h = h2""")
def a03g(spark, d):
    return flat(X.hour_series(spark, d).aggregate_temporal(period="hour"))


@add("a03_gapfill_month", sql(f"""SELECT m.time, k.bands, k.latitude, k.longitude, v.value FROM
(SELECT strftime(unnest(generate_series((SELECT min(time) FROM c2), (SELECT max(time) FROM c2), INTERVAL 1 MONTH)), '%Y-%m') AS time) m
CROSS JOIN (SELECT DISTINCT bands, latitude, longitude FROM c2) k
LEFT JOIN (SELECT strftime(time, '%Y-%m') AS time, bands, latitude, longitude, max(value) AS value FROM c2 GROUP BY ALL) v
ON m.time = v.time AND k.bands = v.bands AND k.latitude = v.latitude AND k.longitude = v.longitude""", *ALL, time=False, cte=C2))
def a03m(spark, d):
    return flat(X.lineitem_cube(spark, d).aggregate_temporal(period="month", reducer="max"))


_GUARD = "CASE WHEN count(value) = count(*) THEN {} END"
REDUCE = {k: _GUARD.format({"sum": "sum(value)"}.get(k, v)) for k, v in SKIP.items() if k != "count"} | {
    "prod": _GUARD.format("product(value / 100)"),
    "any": "CAST(bool_or(coalesce(value > 300, true)) AS INT)",
    "all": "CAST(bool_and(coalesce(value <> 0, true)) AS INT)",
    "count": SKIP["count"],
}

for _r, _e in REDUCE.items():
    _dims = ("bands", "latitude", "longitude") if _r != "prod" else PIX

    @add(f"a06_reduce_{_r}", sql(f"SELECT {', '.join(_dims)}, {_e} AS value FROM d1 GROUP BY ALL", *_dims, cte=D1))
    def a06(spark, d, r=_r):
        c = X.events_cube(spark, d).densify()
        if r == "prod":
            out = c.apply(lambda v: v / 100).reduce_dimension(r, dimension="bands")
        elif r == "any":
            out = c.apply(lambda v: F.when(v.isNotNull(), F.when(v > 300, 1.0).otherwise(0.0))).reduce_dimension(r, dimension="time")
        else:
            out = c.reduce_dimension(r, dimension="time")
        if r in ("any", "all"):
            out = out.of(out.df.withColumn("value", F.col("value").cast("int")))
            return flat(out).withColumn("value", rounded(F.col("value")))
        return flat(out)


@add("a06_reduce_callable", sql("SELECT time, latitude, longitude, max(value) - min(value) AS value FROM c1 GROUP BY ALL", *PIX, cte=C1))
def a06c(spark, d):
    import numpy as np

    return flat(X.events_cube(spark, d).reduce_dimension(np.ptp, dimension="bands"))


@add("a06_reduce_nanmean", sql("SELECT bands, latitude, longitude, avg(value) AS value FROM d1 GROUP BY ALL", "bands", "latitude", "longitude", cte=D1))
def a06n(spark, d):
    return flat(X.events_cube(spark, d).densify().reduce_dimension("numpy.nanmean", dimension="time"))


# windows


def _interpolate_sql(part: str, x: str) -> str:
    w = f"PARTITION BY {part} ORDER BY {x}"
    return f"""SELECT *, CASE WHEN v IS NOT NULL THEN v ELSE va + (vb - va) * (x - xa) / (xb - xa) END AS value FROM (SELECT *,
last_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va, first_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb,
last_value(k IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xa, first_value(k IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xb
FROM (SELECT time, bands, latitude, longitude, value AS v, {x} AS x, CASE WHEN value IS NOT NULL THEN {x} END AS k FROM d1))"""


@add("w01_interpolate_time", sql(_interpolate_sql("bands, latitude, longitude", "epoch(time)").replace("ORDER BY epoch(time)", "ORDER BY x"), *ALL, cte=D1))
def w01a(spark, d):
    return flat(X.events_cube(spark, d).densify().array_interpolate_linear(dimension="time"))


@add("w01_interpolate_bands", sql(_interpolate_sql("time, latitude, longitude", f"CAST(list_position({list(X.EVENT_BANDS)}, bands) AS DOUBLE)").replace(f"ORDER BY CAST(list_position({list(X.EVENT_BANDS)}, bands) AS DOUBLE)", "ORDER BY x"), *ALL, cte=D1))
def w01b(spark, d):
    return flat(X.events_cube(spark, d).densify().array_interpolate_linear(dimension="bands"))


@add("w02_interpolate_array", """SELECT vec_id, (round(embedding[1] + (embedding[4] - embedding[1]) / 3 + 1e-9, 6) + 0.0) AS v1, (round(embedding[1] + (embedding[4] - embedding[1]) * 2 / 3 + 1e-9, 6) + 0.0) AS v2,
CAST(NULL AS DOUBLE) AS v4 FROM (SELECT vec_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS embedding FROM embeddings)""")
def w02(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    gap = F.lit(None).cast("double")
    out = scalar.array_interpolate_linear(F.array(F.col("e")[0], gap, gap, F.col("e")[3], gap))
    return e.select("vec_id", *[rounded(out[i]).alias(f"v{i}") for i in (1, 2, 4)])


KERNELS = {"asym": [[0, 1, 2], [3, 4, 5], [6, 7, 9]], "gaussian": [[1, 2, 1], [2, 4, 2], [1, 2, 1]], "wide": [[1, 2, 3, 4, 5]]}


def _at(axis: str, d: str, border) -> str:
    p = f"CAST({axis} + {d} AS INT)"
    m = lambda n: f"((({p}) % {n}) + {n}) % {n}"
    return {
        "replicate": f"greatest(0, least(7, {p}))",
        "reflect": f"CASE WHEN {m(16)} < 8 THEN {m(16)} ELSE 15 - {m(16)} END",
        "reflect_pixel": f"CASE WHEN {m(14)} < 8 THEN {m(14)} ELSE 14 - {m(14)} END",
        "wrap": m(8),
    }.get(border, p)


def _kernel_sql(kernel, factor: float, border) -> str:
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    rows = ", ".join(f"({dy}, {dx}, {kernel[h - dy][w - dx]})" for dy in range(-h, h + 1) for dx in range(-w, w + 1))
    constant = border if not isinstance(border, str) else "NULL"
    return f"""SELECT t.item, t.latitude, t.longitude, sum(k.w * coalesce(s.value, {constant})) * {factor}::DOUBLE AS value FROM c3 t CROSS JOIN (VALUES {rows}) AS k(dy, dx, w)
LEFT JOIN c3 s ON s.item = t.item AND s.latitude = {_at('t.latitude', 'k.dy', border)} AND s.longitude = {_at('t.longitude', 'k.dx', border)} GROUP BY ALL"""


for _k, _f, _b in (("asym", 1.0, 0), ("gaussian", 0.0625, 0.25), ("asym", 1.0, "replicate"), ("asym", 1.0, "reflect"), ("asym", 1.0, "reflect_pixel"), ("wide", 0.5, "wrap")):

    @add(f"w03_kernel_{_k}_{_b if isinstance(_b, str) else 'constant'}", sql(_kernel_sql(KERNELS[_k], _f, _b), "item", "latitude", "longitude", cte=C3))
    def w03(spark, d, k=_k, f=_f, b=_b):
        return flat(X.embedding_grid(spark, d).apply_kernel(kernel=KERNELS[k], factor=f, border=b))


# resampling

AGG = {"average": "avg(value)", "mode": "min(m)", "max": "max(value)", "min": "min(value)", "med": "median(value)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)", "sum": "sum(value)", "rms": "sqrt(avg(value * value))"}

for _m, _e in AGG.items():
    _bin = "item, floor(latitude / 2) * 2 + 0.5 AS latitude, floor(longitude / 2) * 2 + 0.5 AS longitude"
    if _m == "mode":
        _body = f"""SELECT item, latitude, longitude, min(v) AS value FROM (SELECT *, max(n) OVER (PARTITION BY item, latitude, longitude) AS most FROM
(SELECT {_bin}, round(value, 1) AS v, count(*) AS n FROM c3 GROUP BY ALL)) WHERE n = most GROUP BY ALL"""
    else:
        _body = f"SELECT {_bin}, {_e} AS value FROM c3 GROUP BY ALL"

    @add(f"p01_{_m}", sql(_body, "item", "latitude", "longitude", cte=C3))
    def p01(spark, d, m=_m):
        c = X.embedding_grid(spark, d)
        if m == "mode":
            c = c.apply(lambda v: F.round(v, 1))
        return flat(c.resample_spatial(resolution=2, method=m))


@add("p01_near", sql("SELECT item, latitude - 0.5 AS latitude, longitude - 0.5 AS longitude, value FROM c3 WHERE latitude % 2 = 1 AND longitude % 2 = 1", "item", "latitude", "longitude", cte=C3))
def p01n(spark, d):
    return flat(X.embedding_grid(spark, d).resample_spatial(resolution=2, method="near"))


WEIGHT = {
    "bilinear": lambda d: f"greatest(0, 1 - abs({d}))",
    "cubic": lambda d: f"CASE WHEN abs({d}) < 1 THEN 1.5 * abs({d})**3 - 2.5 * abs({d})**2 + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d})**3 + 2.5 * abs({d})**2 - 4 * abs({d}) + 2 ELSE 0 END",
    "cubicspline": lambda d: f"CASE WHEN abs({d}) < 1 THEN (4 - 6 * abs({d})**2 + 3 * abs({d})**3) / 6 WHEN abs({d}) < 2 THEN (2 - abs({d}))**3 / 6 ELSE 0 END",
    "lanczos": lambda d: f"CASE WHEN abs({d}) < 1e-12 THEN 1 WHEN abs({d}) < 3 THEN 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d})**2 ELSE 0 END",
}

for _m, _w in WEIGHT.items():

    @add(f"p01_{_m}", sql(f"""SELECT item, ty AS latitude, tx AS longitude, sum(value * wy * wx) / sum(wy * wx) AS value FROM c3,
(SELECT i AS sy, -0.25 + j * 0.5::DOUBLE AS ty FROM range(8) a(i), range(16) b(j)) y, (SELECT i AS sx, -0.25 + j * 0.5::DOUBLE AS tx FROM range(8) a(i), range(16) b(j)) x,
LATERAL (SELECT CAST({_w('(sy - ty)')} AS DOUBLE) AS wy, CAST({_w('(sx - tx)')} AS DOUBLE) AS wx) w WHERE c3.latitude = sy AND c3.longitude = sx AND wy <> 0 AND wx <> 0 GROUP BY ALL""", "item", "latitude", "longitude", cte=C3))
    def p01w(spark, d, m=_m):
        return flat(X.embedding_grid(spark, d).resample_spatial(resolution=0.5, method=m))


@add("p01_reproject_3857", sql("""SELECT item, ty AS latitude, tx AS longitude, value FROM c3 JOIN (SELECT ty, tx, floor(degrees(2 * atan(exp(ty / 6378137)) - pi() / 2) + 0.5) AS sy, floor(degrees(tx / 6378137) + 0.5) AS sx FROM
(SELECT n - (i + 0.5) * (n - s) / 8 AS ty FROM range(8) g(i), e) a, (SELECT w + (i + 0.5) * (o - w) / 8 AS tx FROM range(8) g(i), e) b) t ON c3.latitude = t.sy AND c3.longitude = t.sx""", "item", "latitude", "longitude",
    cte=f"{C3}, e AS (SELECT radians(-0.5) * 6378137 AS w, radians(7.5) * 6378137 AS o, ln(tan(pi() / 4 + radians(-0.5) / 2)) * 6378137 AS s, ln(tan(pi() / 4 + radians(7.5) / 2)) * 6378137 AS n)", digits=6).replace("SELECT item, latitude, longitude,", "SELECT item, (round(latitude + 1e-9, 3) + 0.0) AS latitude, (round(longitude + 1e-9, 3) + 0.0) AS longitude,", 1))
def p01r(spark, d):
    out = X.embedding_grid(spark, d).resample_spatial(projection=3857, method="near")
    return out.df.select("item", rounded(F.col("latitude"), 3).alias("latitude"), rounded(F.col("longitude"), 3).alias("longitude"), rounded(F.col("value")).alias("value"))


# reshaping


@add("h01_stack_samples", f"""WITH {C1} SELECT strftime(time, '%Y-%m-%d %H:%M:%S') AS time, latitude, longitude, {', '.join(f"round(max(CASE WHEN bands = '{b}' THEN value END) + 1e-9, 6) + 0.0 AS {b}" for b in X.EVENT_BANDS)} FROM c1 GROUP BY ALL""")
def h01(spark, d):
    df, names = reshape.stack_to_samples(X.events_cube(spark, d), "bands")
    return flat(df.select("time", "latitude", "longitude", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)]))


@add("h05_add_dimension", sql("SELECT item, 'x' AS version, latitude, longitude, value FROM c3", "item", "version", "latitude", "longitude", cte=C3))
def h05(spark, d):
    return flat(reshape.add_dimension(X.embedding_grid(spark, d), "version", "x"))


@add("h06_feature_matrix", "SELECT CAST(c_custkey AS DOUBLE) AS f0, (round(c_acctbal + 1e-9, 6) + 0.0) AS f1, c_nationkey AS target FROM customer")
def h06(spark, d):
    m = reshape.to_feature_matrix(X.customer_points(spark, d), target_column="c_nationkey")
    return flat(m.select(F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), "target"))


# vector


def _xy(cube: DataCube, *names: str, digits: int = 6) -> DataFrame:
    p = F.col("geometry.parts")[0][0][0]
    return cube.df.select(*names, rounded(p["x"], digits).alias("x"), rounded(p["y"], digits).alias("y"))


@add("v01_bbox_points", f"SELECT c_custkey, x, y FROM ({X.POINTS}) WHERE x > -90 AND x < 90 AND y > -45 AND y < 45")
def v01(spark, d):
    return _xy(X.customer_points(spark, d).filter_bbox(west=-90, south=-45, east=90, north=45), "c_custkey")


@add("v02_buffer_points", f"""SELECT c_custkey, i, (round(x + 10 * cos(2 * pi() * (i % 64) / 64) + 1e-9, 6) + 0.0) AS x, (round(y - 10 * sin(2 * pi() * (i % 64) / 64) + 1e-9, 6) + 0.0) AS y FROM ({X.POINTS}), (SELECT CAST(unnest(range(65)) AS INT) AS i)""")
def v02(spark, d):
    c = X.customer_points(spark, d)
    c = DataCube(c.df, CubeSchema(c.schema.dims, crs="EPSG:3857", kind="vector", geometry=("geometry",)))
    df = c.vector_buffer(distance=10).df.select("c_custkey", F.posexplode(F.col("geometry.parts")[0][0]).alias("i", "p"))
    return df.select("c_custkey", "i", rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y"))


@add("v03_reproject_3857", f"SELECT c_custkey, (round(radians(x) * 6378137 + 1e-9, 3) + 0.0) AS x, (round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137 + 1e-9, 3) + 0.0) AS y FROM ({X.POINTS})")
def v03(spark, d):
    return _xy(X.customer_points(spark, d).vector_reproject(projection=3857), "c_custkey", digits=3)


@add("v03_roundtrip", f"SELECT c_custkey, (round(x + 1e-9, 6) + 0.0) AS x, (round(y + 1e-9, 6) + 0.0) AS y FROM ({X.POINTS})")
def v03r(spark, d):
    return _xy(X.customer_points(spark, d).vector_reproject(projection=3857).vector_reproject(projection=4326), "c_custkey")


@add("v03_utm_roundtrip", f"SELECT c_custkey, (round(9 + x / 90 + 1e-9, 5) + 0.0) AS x, (round(y + 1e-9, 5) + 0.0) AS y FROM ({X.POINTS})")
def v03u(spark, d):
    from ..functions import geometry as G

    c = X.customer_points(spark, d)
    p = F.col("geometry.parts")[0][0][0]
    near = DataCube(c.df.withColumn("geometry", G.point(F.lit(9.0) + p["x"] / 90, p["y"])), c.schema)
    return _xy(near.vector_reproject(projection=32632).vector_reproject(projection="EPSG:4326"), "c_custkey", digits=5)


@add("v04_apply", "SELECT c_custkey, (round(c_acctbal * 2 + 1e-9, 6) + 0.0) AS twice FROM customer")
def v04(spark, d):
    out = X.customer_points(spark, d).apply(lambda df: df.withColumn("twice", F.col("c_acctbal") * 2))
    return flat(out.df.select("c_custkey", "twice"))


@add("v05_filter_vector", f"SELECT c_custkey, x, y FROM ({X.POINTS}) WHERE x > -30.5 AND x < 40.5 AND y > 10.5 AND y < 60.5")
def v05(spark, d):
    return _xy(X.customer_points(spark, d).filter_vector(X.box(-30.5, 10.5, 40.5, 60.5)), "c_custkey")


# scalars


@add("f01_eq_number", "SELECT l_orderkey, l_linenumber, l_quantity = 17 AS same, abs(l_discount - l_tax) <= 0.015::DOUBLE AS near FROM lineitem")
def f01a(spark, d):
    li = X.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalar.eq(F.col("l_quantity"), 17).alias("same"), scalar.eq(F.col("l_discount"), F.col("l_tax"), delta=0.015).alias("near"))


@add("f01_eq_string", "SELECT c_custkey, lower(c_mktsegment) = 'building' AS loose, c_mktsegment = 'building' AS exact FROM customer")
def f01b(spark, d):
    c = X.table(spark, d, "customer")
    return c.select("c_custkey", scalar.eq(F.col("c_mktsegment"), "Building", case_sensitive=False).alias("loose"), scalar.eq(F.col("c_mktsegment"), "building").alias("exact"))


@add("f01_eq_mixed", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN false END AS same FROM customer")
def f01c(spark, d):
    c = X.table(spark, d, "customer")
    return c.select("c_custkey", scalar.eq_mixed(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")), F.col("c_name")).alias("same"))


_BOOL = "CASE WHEN {0} % 3 = 0 THEN true WHEN {0} % 3 = 1 THEN false END"


@add("f02_or", f"SELECT c_custkey, ({_BOOL.format('c_custkey')}) OR ({_BOOL.format('c_nationkey')}) AS either FROM customer")
def f02(spark, d):
    c = X.table(spark, d, "customer")
    b = lambda n: F.when(F.col(n) % 3 == 0, True).when(F.col(n) % 3 == 1, False)
    return c.select("c_custkey", scalar.or_(b("c_custkey"), b("c_nationkey")).alias("either"))


@add("f03_median", "SELECT vec_id, (round(list_aggregate([CAST(e AS DOUBLE) FOR e IN embedding], 'median') + 1e-9, 6) + 0.0) AS mid FROM embeddings")
def f03(spark, d):
    e = X.table(spark, d, "embeddings")
    return e.select("vec_id", rounded(scalar.median(F.transform("embedding", lambda v: v.cast("double")))).alias("mid"))


@add("f04_array_element", "SELECT vec_id, (round(CAST(embedding[4] AS DOUBLE) + 1e-9, 6) + 0.0) AS third, CAST(NULL AS DOUBLE) AS beyond FROM embeddings")
def f04(spark, d):
    e = X.table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", rounded(scalar.array_element(v, index=3)).alias("third"), scalar.array_element(v, index=64, return_nodata=True).alias("beyond"))


@add("f07_period_labels", "SELECT o_orderkey, " + ", ".join(f"{_l.replace('time', 'o_orderdate') if 'strftime' not in _l else _l.replace('(time', '(o_orderdate')} AS {_p.replace('-', '_')}" for _p, _l in LABEL.items()) + " FROM orders")
def f07(spark, d):
    o = X.table(spark, d, "orders")
    t = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", *[periods.label(p, t).alias(p.replace("-", "_")) for p in LABEL])


# chains


@add("chain_ndvi_month", sql(f"SELECT strftime(time, '%Y-%m') AS time, latitude, longitude, median(value) AS value FROM ({_ndvi_sql('c1', 'view', 'click')}) WHERE longitude BETWEEN 0 AND 3 GROUP BY ALL", *PIX, time=False, cte=C1))
def chain(spark, d):
    c = X.events_cube(spark, d).filter_bbox(west=0, south=0, east=3, north=4).ndvi(nir="view", red="click")
    return flat(c.aggregate_temporal(period="month", reducer="median"))


# models


def _training(spark, d) -> DataCube:
    e = X.table(spark, d, "embeddings")
    df = e.select(*[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)], (F.col("label") % 3).alias("label"))
    return DataCube(df, CubeSchema(kind="vector"))


def _predicted(spark, d, model) -> DataFrame:
    from ..ml import ml_fit, ml_predict

    return ml_predict(X.embedding_grid(spark, d), ml_fit(model, _training(spark, d), "label")).df


SPACE = ["latitude", "longitude"]


@add("m01_forest_predict")
def m01(spark, d):
    from ..ml import mlm_class_random_forest

    return _predicted(spark, d, mlm_class_random_forest(num_trees=10, seed=1, dimension=SPACE))


@add("m02_forest_regression")
def m02(spark, d):
    from ..ml import mlm_regr_random_forest

    return _predicted(spark, d, mlm_regr_random_forest(num_trees=10, seed=1, dimension=SPACE))


@add("m03_boosted_predict")
def m03(spark, d):
    from ..ml import mlm_class_xgboost

    return _predicted(spark, d, mlm_class_xgboost(seed=1, dimension=SPACE, max_depth=3, rounds=3))


@add("m04_tempcnn_predict")
def m04(spark, d):
    from ..ml import mlm_class_tempcnn

    return _predicted(spark, d, mlm_class_tempcnn(cnn_layers=[8, 8], cnn_kernels=[5, 5], cnn_dropout_rates=[0.1, 0.1], dense_layer_nodes=16, epochs=3, seed=1, dimension=SPACE))


@add("m05_lighttae_predict")
def m05(spark, d):
    from ..ml import mlm_class_lighttae

    return _predicted(spark, d, mlm_class_lighttae(epochs=1, seed=1, dimension=SPACE))


@add("u07_registry", f"SELECT unnest({ProcessRegistry().list_processes()}) AS id")
def u07(spark, d):
    return spark.createDataFrame([(k,) for k in ProcessRegistry().list_processes()], "id string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened with filters at the scan, then the index."""
    c = load_collection("events", adapter=_collection(spark, sf_dir), spatial_extent={"west": 0, "south": 0, "east": 3, "north": 4}, temporal_extent=("2024-01-01", "2024-01-20"))
    c = c.with_labels("bands", X.EVENT_BANDS)
    return c.ndvi(nir="view", red="click").df
