"""Operators on vector cubes."""

from __future__ import annotations

import math
from dataclasses import replace

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import DataCube
from ..errors import DimensionNotAvailable
from ..functions import geometry as G
from ..functions.crs import assert_metres, epsg, normal, transform

RELATIONS = ("intersects", "disjoint", "equals", "touches", "crosses", "overlaps", "contains", "within")


def _geometry(cube: DataCube) -> str:
    if not cube.schema.geometry:
        raise TypeError("the cube has no geometry")
    return cube.schema.geometry[0]


def filter_bbox(cube: DataCube, *, west, south, east, north) -> DataCube:
    """Features whose geometry lies in the box, not merely on its edge."""
    cube.need_vector()
    b = G.bbox(F.col(_geometry(cube)))
    within = (b["xmin"] >= west) & (b["ymin"] >= south) & (b["xmax"] <= east) & (b["ymax"] <= north)
    # something of it is inside: it is not all on one edge
    edge = (b["xmax"] <= west) | (b["xmin"] >= east) | (b["ymax"] <= south) | (b["ymin"] >= north)
    return cube.of(cube.df.where(within & ~edge))


def apply(cube: DataCube, process, *, context=None) -> DataCube:
    """A function of the frame: of the DataFrame, or of pandas frames a part at a time where it returns no DataFrame."""
    cube.need_vector()
    more = {} if context is None else {"context": context}
    try:
        out = process(cube.df, **more)
    except (TypeError, ValueError, AttributeError, PySparkException):  # not a function of a DataFrame: it is then one of pandas frames
        out = None
    if not isinstance(out, DataFrame):
        schema = cube.df.schema
        out = cube.df.mapInPandas(lambda parts: (process(p, **more) for p in parts), schema)
    return cube.of(out)


def circle(x: Column, y: Column, distance: float, segments: int = 16) -> Column:
    """A polygon of four times ``segments`` corners around a point, the first again at the end."""
    n = 4 * segments
    corner = lambda i: F.struct((x + distance * F.cos(i * (2 * math.pi / n))).alias("x"), (y - distance * F.sin(i * (2 * math.pi / n))).alias("y"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: corner(F.pmod(i, F.lit(n))))
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring)).alias("parts"))


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that become much larger; given as a number, adaptive execution leaves them as they are."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def vector_buffer(cube: DataCube, *, distance: float) -> DataCube:
    """Geometries grown (or, below 0, shrunk) by metres, as polygons of 16 segments a quarter; attributes stay.

    Points are exact in plain Column math.  Lines of one segment and convex polygons go through Arrow; other shapes
    are not implemented.
    """
    cube.need_vector()
    if distance == 0:
        raise ValueError("a distance of 0 buffers nothing")
    assert_metres(cube.schema.crs)
    name = _geometry(cube)
    g = F.col(name)

    @F.pandas_udf(G.TYPE)
    def grown(shapes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, parts in zip(shapes["type"], shapes["parts"], strict=True):
            if parts is None or not len(parts):
                out.append((kind, parts))
                continue
            rings = [[[(p["x"], p["y"]) for p in r] for r in part] for part in parts]
            if len(rings) > 1 or len(rings[0]) > 1 or (kind == "Polygon" and not G.is_convex(rings[0][0])) or (kind == "LineString" and len(rings[0][0]) > 2):
                raise NotImplementedError(f"buffers of a {kind} that is not convex")
            ring = G.buffer_convex(rings[0][0], distance) if kind == "Polygon" or distance > 0 else []
            out.append(("Polygon", [[[{"x": x, "y": y} for x, y in ring]]] if ring else []))
        return pd.DataFrame(out, columns=["type", "parts"])

    p = F.get(F.get(F.get(g["parts"], F.lit(0)), F.lit(0)), F.lit(0))
    still = g.isNull() | (F.size(g["parts"]) <= 0)
    points = cube.df.where(g.isNull() | (g["type"] == "Point"))
    if distance > 0:
        # a circle is many times its point, and a small file is read by few tasks: points are dealt out before they grow
        points = points.withColumns({"__still": still, "__x": p["x"], "__y": p["y"], name: F.when(still, g)}).repartition(_tasks(cube.df))
        round_ = circle(F.col("__x"), F.col("__y"), distance)
        points = points.withColumn(name, F.when(F.col("__still"), g).otherwise(round_)).drop("__still", "__x", "__y")
    else:
        nothing = F.struct(F.lit("Polygon").alias("type"), F.array().cast(G.TYPE.split("parts:")[1][:-1]).alias("parts"))
        points = points.withColumn(name, F.when(still, g).otherwise(nothing))
    others = cube.df.where(g["type"] != "Point").withColumn(name, grown(g))
    return cube.of(points.unionByName(others))


def vector_reproject(cube: DataCube, *, projection, dimension: str | None = None) -> DataCube:
    """Vertices in another coordinate system, x before y."""
    cube.need_vector()
    names = list(cube.schema.geometry)
    if dimension is not None:
        if dimension not in names:
            raise DimensionNotAvailable(f"no geometry dimension {dimension!r}; there are {names}")
        names = [dimension]
    source, target = normal(cube.schema.crs or 4326), normal(projection)
    if epsg(source) == epsg(target):
        return cube.of(cube.df, replace(cube.schema, crs=target))

    def moved(p):
        x, y = transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    df = cube.df
    for n in names:
        g = F.col(n)
        parts = F.transform(g["parts"], lambda part: F.transform(part, lambda r: F.transform(r, moved)))
        df = df.withColumn(n, F.when(g.isNotNull(), F.struct(g["type"].alias("type"), parts.alias("parts"))))
    return cube.of(df, replace(cube.schema, crs=target))


def filter_vector(cube: DataCube, geometries, relation: str = "intersects") -> DataCube:
    """Points of the cube by their relation to polygons (intersects, within, disjoint), envelopes first.

    For other shapes, and the other relations, envelopes alone would not do; they are not implemented.
    """
    cube.need_vector()
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}; there are {RELATIONS}")
    if relation not in ("intersects", "within", "disjoint"):
        raise NotImplementedError(f"relation {relation!r}")
    g = F.col(_geometry(cube))
    shapes = G.polygons(geometries)
    p = F.get(F.get(F.get(g["parts"], F.lit(0)), F.lit(0)), F.lit(0))
    hit = G.contains_fixed(shapes, p["x"], p["y"])
    checked = F.when(g["type"] == "Point", hit).when(g.isNotNull(), F.raise_error(F.lit("only points are filtered by polygons")).cast("boolean"))
    return cube.of(cube.df.where(~checked if relation == "disjoint" else checked))
