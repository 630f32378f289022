"""Collections: tables of cells, with filters that reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions.crs import epsg, transform_bbox
from ..functions.nodata import clean
from ..operators.filters import temporal_bounds
from ..schema import CubeSchema, Dim

#: Names that providers give to dimensions, and ours.
RENAMES = {"band": "bands", "y": "latitude", "x": "longitude", "t": "time"}
ROLES = {"time": "temporal", "bands": "bands", "latitude": "y", "longitude": "x"}

#: Common names of Sentinel-2 bands.
COMMON_NAMES = {
    "coastal": "B01", "blue": "B02", "green": "B03", "red": "B04", "rededge1": "B05", "rededge2": "B06", "rededge3": "B07",
    "nir": "B08", "nir08": "B8A", "nir09": "B09", "cirrus": "B10", "swir16": "B11", "swir22": "B12", "scl": "SCL",
}


def resolve_bands(available: Sequence[str], bands: Sequence[str]) -> list[str]:
    """The available key of each band: the same, else the same but for case, else by its common name (either way)."""
    by_case = {k.lower(): k for k in available}
    reverse = {v.lower(): k for k, v in COMMON_NAMES.items()}
    out = []
    for b in bands:
        low = b.lower()
        found = b if b in available else by_case.get(low)
        if found is None:
            for other in (COMMON_NAMES.get(low), reverse.get(low)):
                if other is not None and other.lower() in by_case:
                    found = by_case[other.lower()]
                    break
        if found is None:
            raise ValueError(f"no band {b!r}; there are {sorted(available)[:24]}")
        out.append(found)
    return out


def property_filter(properties: dict) -> list:
    """Conditions of ``{"column": {"lt": 50}}`` or ``{"column": value}``."""
    ops = {"eq": "__eq__", "neq": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
    out = []
    for name, rule in properties.items():
        for op, v in (rule if isinstance(rule, dict) else {"eq": rule}).items():
            if op == "in":
                out.append(F.col(name).isin(*v))
            elif op in ops:
                out.append(getattr(F.col(name), ops[op])(v))
            else:
                raise ValueError(f"no comparison {op!r}")
    return out


class CollectionLoader(Protocol):
    """What loads collections."""

    def load_collection(self, collection_id: str, *, spatial_extent=None, temporal_extent=None, bands=None, properties=None, **kwargs) -> DataCube: ...


class ParquetCollectionLoader:
    """Collections that are Parquet tables of cells, ``<root>/<id>``, or DataFrames made by functions.

    Box, interval, bands and properties become conditions on columns, so Parquet statistics and partitions (by band,
    say) prune what is read, and only the dimensions and the value are selected.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, Callable[[], DataFrame]] | None = None, crs: str = "EPSG:4326"):
        self.spark, self.root, self.tables, self.crs = spark, root, tables or {}, crs

    def _open(self, collection_id: str) -> DataFrame:
        if collection_id in self.tables:
            return self.tables[collection_id]()
        if self.root is None:
            raise ValueError(f"no collection {collection_id!r}")
        return self.spark.read.parquet(f"{self.root}/{collection_id}")

    def load_collection(self, collection_id: str, *, spatial_extent=None, temporal_extent=None, bands=None, properties=None, value: str = "value", check_empty: bool = False, **kwargs) -> DataCube:
        df = self._open(collection_id)
        for old, new in RENAMES.items():
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        if spatial_extent is not None:
            e = dict(spatial_extent)
            box = (e["west"], e["south"], e["east"], e["north"])
            if e.get("crs") is not None and epsg(e["crs"]) != epsg(self.crs):
                box = transform_bbox(box, e["crs"], self.crs)
            df = df.where(F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3]))
        if temporal_extent is not None:
            df = df.where(temporal_bounds("time", temporal_extent))
        for c in property_filter(properties or {}):
            df = df.where(c)
        labels = tuple(bands) if bands is not None else None
        if bands is not None:
            # a handful of names: those of the rows that the other filters leave, else of all rows
            try:
                keys = resolve_bands([r[0] for r in df.select("bands").distinct().collect()], bands)
            except ValueError:
                whole = self._open(collection_id)
                name = "bands" if "bands" in whole.columns else "band"
                keys = resolve_bands([r[0] for r in whole.select(name).distinct().collect()], bands)
            df = df.where(F.col("bands").isin(keys))
            named = F.create_map(*[F.lit(v) for k, b in zip(keys, bands, strict=True) for v in (k, b)])
            if list(keys) != list(bands):
                df = df.withColumn("bands", named[F.col("bands")])
        names = [n for n in ("time", "bands", "latitude", "longitude") if n in df.columns]
        out = df.select(*names, clean(F.col(value).cast("double")).alias("value"))
        if check_empty and out.isEmpty():
            raise ValueError(f"collection {collection_id!r} has no data there")
        dims = tuple(Dim(n, ROLES[n], labels if n == "bands" else None) for n in names)
        return DataCube(out, CubeSchema(dims, crs=self.crs))


def load_collection(collection_id: str, *, adapter: CollectionLoader, spatial_extent=None, temporal_extent=None, bands=None, properties=None, **kwargs) -> DataCube:
    return adapter.load_collection(collection_id, spatial_extent=spatial_extent, temporal_extent=temporal_extent, bands=bands, properties=properties, **kwargs)
