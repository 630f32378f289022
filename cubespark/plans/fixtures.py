"""Cubes from star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions import geometry as G
from ..schema import CubeSchema, Dim

GRID = (Dim("time", "temporal"), Dim("bands", "bands"), Dim("latitude", "y"), Dim("longitude", "x"))
EVENT_BANDS = ("click", "error", "purchase", "signup", "view")
MEASURES = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_cube(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataCube:
    """Days x event types x 5 x 5 pixels: the mean value."""
    e = table(spark, sf_dir, "events")
    df = e.groupBy(
        F.date_trunc(unit, "ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("bands"),
        (F.floor(F.col("user_id") / 5) % 5).cast("double").alias("latitude"),
        (F.col("user_id") % 5).cast("double").alias("longitude"),
    ).agg(F.avg("value").alias("value"))
    return DataCube(df, CubeSchema(tuple(Dim(d.name, d.role, EVENT_BANDS if d.name == "bands" else None) for d in GRID), crs="EPSG:4326"))


EVENTS = """SELECT date_trunc('{unit}', ts) AS time, event_type AS bands, CAST((user_id // 5) % 5 AS DOUBLE) AS latitude,
CAST(user_id % 5 AS DOUBLE) AS longitude, avg(value) AS value FROM events GROUP BY ALL"""


def hour_series(spark: SparkSession, sf_dir: str) -> DataCube:
    """The mean value of each hour that has an event."""
    e = table(spark, sf_dir, "events")
    return DataCube(e.select(F.col("ts").cast("timestamp").alias("time"), F.col("value").cast("double").alias("value")), CubeSchema((Dim("time", "temporal"),)))


def lineitem_cube(spark: SparkSession, sf_dir: str, side: int = 10) -> DataCube:
    """Months x four measures x pixels by supplier and part: the mean."""
    li = table(spark, sf_dir, "lineitem")
    pixel = (
        li.groupBy(
            F.date_trunc("month", "l_shipdate").cast("timestamp").alias("time"),
            (F.col("l_suppkey") % side).cast("double").alias("latitude"),
            (F.col("l_partkey") % side).cast("double").alias("longitude"),
        )
    ).agg(*[F.avg(c).alias(n) for n, c in MEASURES.items()])
    df = pixel.unpivot(["time", "latitude", "longitude"], list(MEASURES), "bands", "value").select("time", "bands", "latitude", "longitude", "value")
    return DataCube(df, CubeSchema(tuple(Dim(d.name, d.role, tuple(MEASURES) if d.name == "bands" else None) for d in GRID)))


LINEITEM = """SELECT time, bands, latitude, longitude, value FROM (SELECT date_trunc('month', l_shipdate) AS time,
CAST(l_suppkey % 10 AS DOUBLE) AS latitude, CAST(l_partkey % 10 AS DOUBLE) AS longitude, avg(l_extendedprice) AS price,
avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY ALL)
UNPIVOT (value FOR bands IN (price, quantity, discount, tax))"""


def embedding_grid(spark: SparkSession, sf_dir: str) -> DataCube:
    """Items x 8 x 8: each embedding as a small image."""
    e = table(spark, sf_dir, "embeddings")
    df = e.select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("i", "v"))
    df = df.select("item", F.floor(F.col("i") / 8).cast("double").alias("latitude"), (F.col("i") % 8).cast("double").alias("longitude"), F.col("v").cast("double").alias("value"))
    side = tuple(float(i) for i in range(8))
    return DataCube(df, CubeSchema((Dim("item"), Dim("latitude", "y", side), Dim("longitude", "x", side)), crs="EPSG:4326"))


EMBEDDING = """SELECT item, CAST(i // 8 AS DOUBLE) AS latitude, CAST(i % 8 AS DOUBLE) AS longitude, CAST(v AS DOUBLE) AS value FROM
(SELECT vec_id AS item, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""


def quality_cube(spark: SparkSession, sf_dir: str) -> DataCube:
    """Months x pixels with a 16-bit pattern as the quality band."""
    li = table(spark, sf_dir, "lineitem")
    df = li.groupBy(
        F.date_trunc("month", "l_shipdate").cast("timestamp").alias("time"),
        F.lit("QA_PIXEL").alias("bands"),
        (F.col("l_suppkey") % 10).cast("double").alias("latitude"),
        (F.col("l_partkey") % 10).cast("double").alias("longitude"),
    ).agg(F.min(F.col("l_orderkey") % 65536).cast("double").alias("value"))
    return DataCube(df, CubeSchema(tuple(Dim(d.name, d.role, ("QA_PIXEL",) if d.name == "bands" else None) for d in GRID)))


QUALITY = """SELECT date_trunc('month', l_shipdate) AS time, CAST(l_suppkey % 10 AS DOUBLE) AS latitude,
CAST(l_partkey % 10 AS DOUBLE) AS longitude, min(l_orderkey % 65536) AS qa FROM lineitem GROUP BY ALL"""


def customer_points(spark: SparkSession, sf_dir: str) -> DataCube:
    c = table(spark, sf_dir, "customer")
    x, y = (F.col("c_custkey") * 37 % 360 - 180).cast("double"), (F.col("c_custkey") * 17 % 170 - 85).cast("double")
    df = c.select("c_custkey", "c_acctbal", "c_nationkey", G.point(x, y).alias("geometry"))
    return DataCube(df, CubeSchema((Dim("geometry", "geometry"),), crs="EPSG:4326", kind="vector", geometry=("geometry",)))


POINTS = """SELECT c_custkey, c_acctbal, c_nationkey, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS x,
CAST(c_custkey * 17 % 170 - 85 AS DOUBLE) AS y FROM customer"""


def box(x0, y0, x1, y1) -> dict:
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


ZONES = {
    "a": box(0.5, 0.5, 3.5, 3.5),
    "b": box(2.5, 1.5, 7.5, 5.5),
    "c": box(6.5, 6.5, 9.5, 9.5),
    "d": box(-0.5, 8.5, 9.5, 9.5),
    "t": {"type": "Polygon", "coordinates": [[[0.25, 0.5], [8.25, 0.5], [0.25, 8.5], [0.25, 0.5]]]},
}
#: The same as conditions.
ZONE_SQL = {
    "a": "longitude BETWEEN 0.5 AND 3.5 AND latitude BETWEEN 0.5 AND 3.5",
    "b": "longitude BETWEEN 2.5 AND 7.5 AND latitude BETWEEN 1.5 AND 5.5",
    "c": "longitude BETWEEN 6.5 AND 9.5 AND latitude BETWEEN 6.5 AND 9.5",
    "d": "longitude BETWEEN -0.5 AND 9.5 AND latitude BETWEEN 8.5 AND 9.5",
    "t": "longitude > 0.25 AND latitude > 0.5 AND longitude + latitude < 8.75",
}


def zones(spark: SparkSession) -> DataCube:
    rows = [(i, k, G.from_geojson(g)) for i, (k, g) in enumerate(ZONES.items())]
    df = spark.createDataFrame(rows, f"geom_id long, zone string, geometry {G.TYPE}")
    return DataCube(df, CubeSchema((Dim("geometry", "geometry"),), kind="vector", geometry=("geometry",)))
