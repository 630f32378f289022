"""Each query against DuckDB on the same tables, as the driver does it."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry  # registers all queries
from cubespark.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


def normal(pdf):
    cols = sorted(pdf.columns)
    number = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted(repr([number(v.item() if hasattr(v, "item") else v) for v in row]) for row in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, con, name):
    assert normal(QUERIES[name](spark, data).toPandas()) == normal(con.sql(SQL[name]).df())


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["time", "latitude", "longitude", "value"]
    assert df.count() > 0


def test_filters_reach_the_scan(spark, data):
    from cubespark.cube import DataCube
    from cubespark.schema import CubeSchema, Dim

    path = f"{data}/events.parquet"
    df = spark.read.parquet(path).select("ts", "event_id", "value")
    cube = DataCube(df.withColumnRenamed("event_id", "longitude").withColumn("latitude", F.col("longitude")), CubeSchema((Dim("longitude"), Dim("latitude"))))
    plan = cube.filter_bbox(west=1, south=1, east=9, north=9).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,1)" in plan.replace(" ", "")
