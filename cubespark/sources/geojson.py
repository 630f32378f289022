"""GeoJSON as vector cubes."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cube import DataCube

from ..functions.crs import normal
from ..schema import CubeSchema, Dim

#: Coordinates are kept as text by the reader, as their depth varies by type.
FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:string>"


class GeoJsonLoader(Protocol):
    """What loads GeoJSON."""

    def load_geojson(self, spark: SparkSession, source, *, crs=None) -> DataCube: ...


def _parsed(kind, text):
    point = F.from_json(text, "array<double>")
    line = F.from_json(text, "array<array<double>>")
    poly = F.from_json(text, "array<array<array<double>>>")
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, pt)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(pt(point)))))
        .when(kind == "MultiPoint", F.transform(line, lambda p: F.array(F.array(pt(p)))))
        .when(kind == "LineString", F.array(F.array(ring(line))))
        .when(kind == "MultiLineString", F.transform(poly, lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(poly, ring)))
        .when(kind == "MultiPolygon", F.transform(multi, lambda p: F.transform(p, ring)))
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts")))


def from_features(features: DataFrame, properties: dict[str, str]) -> DataFrame:
    """Rows of ``FEATURE`` as attributes and ``geometry``."""
    props = F.from_json("properties", ", ".join(f"`{k}` {v}" for k, v in properties.items())) if properties else None
    cols = [props[k].alias(k) for k in properties] if properties else []
    return features.select(*cols, _parsed(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometry"))


def _kinds(feature_properties: list[dict]) -> dict[str, str]:
    out: dict[str, str] = {}
    for p in feature_properties:
        for k, v in (p or {}).items():
            kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
            if v is None:
                out.setdefault(k, "void")
            elif out.get(k, "void") in ("void", kind):
                out[k] = kind
            else:
                out[k] = "double" if {out[k], kind} == {"bigint", "double"} else "string"
    return {k: "string" if v == "void" else v for k, v in out.items()}


def _kinds_of_rows(features: DataFrame) -> dict[str, str]:
    """``_kinds`` over all rows of ``FEATURE``; the driver gets a row for each name, in order of first occurrence."""
    values = features.select(F.monotonically_increasing_id().alias("row"), F.from_json("properties", "map<string,variant>").alias("m"))
    values = values.select("row", F.posexplode("m").alias("pos", "name", "value"))
    of = F.schema_of_variant("value")
    kind = (
        F.when(F.col("value").isNull() | (of == "VOID"), F.lit(None).cast("string"))
        .when(of == "BOOLEAN", "boolean")
        .when(of == "BIGINT", "bigint")
        .when((of == "DOUBLE") | of.startswith("DECIMAL"), "double")
        .otherwise("string")
    )
    found = values.groupBy("name").agg(F.collect_set(kind).alias("kinds"), F.min(F.struct("row", "pos")).alias("first"))
    out = {}
    for r in found.orderBy("first").collect():
        out[r["name"]] = r.kinds[0] if len(r.kinds) == 1 else "double" if set(r.kinds) == {"bigint", "double"} else "string"
    return out


def load_geojson(spark: SparkSession, source, *, crs=None, properties: dict[str, str] | None = None, adapter: GeoJsonLoader | None = None) -> DataCube:
    """A vector cube from a dict or a path that Spark reads.

    Without ``crs`` it is EPSG:4326; with it the coordinates are taken as they are.  ``properties`` names columns and
    types; else they are taken from all features.
    """
    if adapter is not None:
        return adapter.load_geojson(spark, source, crs=crs)
    if isinstance(source, dict):
        features = source["features"] if "features" in source else [source]
        rows = [("Feature", None if f.get("geometry") is None else (f["geometry"]["type"], json.dumps(f["geometry"].get("coordinates"))), json.dumps(f.get("properties") or {})) for f in features]
        df = spark.createDataFrame(rows, T._parse_datatype_string(FEATURE))
        kinds = properties or _kinds([f.get("properties") for f in features])
    else:
        raw = spark.read.schema(f"type string, features array<{FEATURE}>, geometry struct<type:string,coordinates:string>, properties string").option("multiLine", True).json(str(source))
        one = F.array(F.struct("type", "geometry", "properties"))
        df = raw.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(one)).alias("f")).select("f.*")
        kinds = properties or _kinds_of_rows(df)
    out = from_features(df, kinds)
    return DataCube(out, CubeSchema((Dim("geometry", "geometry"),), crs=normal(crs if crs is not None else 4326), kind="vector", geometry=("geometry",)))


