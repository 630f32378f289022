"""Results as files."""

from __future__ import annotations

from ..cube import DataCube
from ..functions import geometry as G

FORMATS = {"parquet": "parquet", "orc": "orc", "json": "json", "csv": "csv", "geojson": "geojson"}


def save_result(cube: DataCube, path: str, format: str = "parquet", *, mode: str = "error", partition_by: list[str] | None = None, **options) -> bool:
    """Writes a cube; an unknown format and an empty cube are errors.  GeoJSON is one feature a line, of a vector cube."""
    kind = FORMATS.get(format.lower())
    if kind is None:
        raise ValueError(f"no format {format!r}; there are {sorted(FORMATS)}")
    if cube.df.isEmpty():
        raise ValueError("the cube is empty")
    df = cube.df
    if kind == "geojson":
        if not cube.is_vector:
            raise TypeError("GeoJSON holds vector cubes")
        import json

        names = [c for c in df.columns if c not in cube.schema.geometry]

        def line(r):
            g = r["geometry"]
            return json.dumps({"type": "Feature", "geometry": None if g is None else G.to_geojson(g), "properties": {n: r[n] for n in names}})

        from pyspark.sql import functions as F

        to_line = F.udf(lambda r: line(r), "string")
        df.select(to_line(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)
        return True
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)
    return True
