"""STAC items: metadata documents whose assets are tables of cells."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions.nodata import clean
from ..operators.filters import bounds
from ..schema import CubeSchema, Dim
from .collection import RENAMES, ROLES, resolve_bands


class StacLoader(Protocol):
    """What loads STAC items."""

    def load_stac(self, spark: SparkSession, source, *, assets=None, spatial_extent=None, temporal_extent=None, **kwargs) -> DataCube: ...


def resolve_items(spark: SparkSession, source) -> list[dict]:
    """The items of a Feature, a FeatureCollection, a catalogue with items, or a file with one of these."""
    if not isinstance(source, dict):
        if str(source).startswith(("http://", "https://")):
            raise ValueError("remote catalogues need a loader of their own (adapter)")
        text = "\n".join(r[0] for r in spark.read.text(str(source), wholetext=True).collect())
        source = json.loads(text)
    kind = source.get("type")
    if kind == "Feature":
        return [source]
    if kind == "FeatureCollection":
        return list(source["features"])
    if kind in ("Catalog", "Collection"):
        return [i for link in source.get("links", []) if link.get("rel") in ("item", "child") for i in resolve_items(spark, link["href"])]
    raise ValueError(f"no STAC document: {kind!r}")


def in_extent(items: list[dict], temporal_extent) -> list[dict]:
    """Items with a datetime inside the closed interval; those without one go."""
    if temporal_extent is None:
        return items
    lo, hi = bounds(temporal_extent)
    stamp = lambda i: (i.get("properties", {}).get("datetime") or "").replace("T", " ").removesuffix("Z")
    return [i for i in items if stamp(i) and (lo is None or stamp(i) >= lo) and (hi is None or stamp(i) < hi)]


def load_stac(spark: SparkSession, source, *, assets=None, spatial_extent=None, temporal_extent=None, adapter: StacLoader | None = None) -> DataCube:
    """A cube of the items' assets: Parquet tables with (latitude, longitude, value), one for each item and band."""
    if adapter is not None:
        return adapter.load_stac(spark, source, assets=assets, spatial_extent=spatial_extent, temporal_extent=temporal_extent)
    items = in_extent(resolve_items(spark, source), temporal_extent)
    if not items:
        raise ValueError("no item lies in the extent")
    frames, labels = [], []
    for item in items:
        names = list(assets) if assets is not None else sorted(item["assets"])
        for name, key in zip(names, resolve_bands(list(item["assets"]), names), strict=True):
            df = spark.read.parquet(item["assets"][key]["href"])
            for old, new in RENAMES.items():
                if old in df.columns and new not in df.columns:
                    df = df.withColumnRenamed(old, new)
            stamp = F.lit(item["properties"]["datetime"].replace("T", " ").removesuffix("Z")).cast("timestamp")
            frames.append(df.select(stamp.alias("time"), F.lit(name).alias("bands"), "latitude", "longitude", clean(F.col("value").cast("double")).alias("value")))
            if name not in labels:
                labels.append(name)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    cube = DataCube(out, CubeSchema(tuple(Dim(n, r, tuple(labels) if n == "bands" else None) for n, r in ROLES.items()), crs="EPSG:4326"))
    return cube.filter_bbox(**spatial_extent) if spatial_extent is not None else cube
