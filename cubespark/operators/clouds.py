"""Cloud probabilities."""

from __future__ import annotations

import importlib

import pandas as pd
from pyspark.sql import functions as F

from ..cube import DataCube
from ..schema import Dim
from .reshape import wide

S2_BANDS = ("B01", "B02", "B04", "B05", "B08", "B8A", "B09", "B10", "B11", "B12")
QA = "QA_PIXEL"


def detect_method(labels) -> str:
    if QA in labels:
        return "Fmask"
    if sum(b in labels for b in S2_BANDS) >= 6:
        return "s2cloudless"
    if any(str(b).startswith("SR_B") for b in labels):
        raise ValueError(f"Landsat bands without {QA}: the quality band is needed")
    raise ValueError(f"no cloud detection fits the bands {sorted(map(str, labels))}")


def cloud_detection(cube: DataCube, *, method: str | None = None, options: dict | None = None, bands_dim: str = "bands") -> DataCube:
    """Probabilities of clouds (and shadows) as bands: from a quality band (Fmask), or by a detector (s2cloudless)."""
    cube.need_raster()
    labels = cube.labels(bands_dim)
    method = method or detect_method(labels)
    name = method.lower()
    if name == "fmask":
        return fmask(cube, options or {}, bands_dim)
    if name == "s2cloudless":
        return s2cloudless(cube, options or {}, bands_dim)
    if name == "sen2cor":
        raise ValueError("Sen2Cor is not yet implemented")
    raise ValueError(f"cloud detection by {method!r} is not supported")


def fmask(cube: DataCube, options: dict, bands_dim: str = "bands") -> DataCube:
    """Confidence bits of the quality band in thirds: 8-9 for clouds, 10-11 for shadows."""
    if QA not in cube.labels(bands_dim):
        raise ValueError(f"Fmask needs band {QA}")
    spatial = [d for d in cube.schema.dims if d.name != bands_dim and d.role != "temporal"]
    if len(spatial) != 2:
        raise ValueError(f"two spatial dimensions are needed, not {[d.name for d in spatial]}")
    out = [("cloud", 8)] + ([("shadow", 10)] if options.get("include_shadow", True) else [])
    value, keys = cube.schema.value, cube.schema.others(bands_dim)
    qa = F.col(value).cast("int")
    pairs = F.array(*[F.struct(F.lit(n).alias("b"), (F.shiftright(qa, bit).bitwiseAND(F.lit(3)) / F.lit(3.0)).alias("v")) for n, bit in out])
    df = cube.df.where(F.col(bands_dim) == QA).select(*keys, F.explode(pairs).alias("__e"))
    df = df.select(*keys, F.col("__e.b").alias(bands_dim), F.col("__e.v").alias(value))
    return cube.of(df.select(*cube.schema.names, value), cube.schema.with_dim(Dim(bands_dim, "bands", tuple(n for n, _ in out))))


def s2cloudless(cube: DataCube, options: dict, bands_dim: str = "bands") -> DataCube:
    """Probabilities by the s2cloudless package, an image (time) at a time; values above 10 are scaled by 10000."""
    try:
        importlib.import_module("s2cloudless")
    except ImportError as e:
        raise ImportError("cloud detection by s2cloudless needs the package s2cloudless") from e
    missing = [b for b in S2_BANDS if b not in cube.labels(bands_dim)]
    if missing:
        raise ValueError(f"s2cloudless needs the bands {missing}")
    value, times = cube.schema.value, [d.name for d in cube.schema.dims if d.role == "temporal"]
    space = [n for n in cube.schema.names if n not in (*times, bands_dim)]
    if len(space) != 2:
        raise ValueError("two spatial dimensions are needed")
    flat = wide(cube, list(S2_BANDS), bands_dim)
    settings = {"threshold": 0.4, "average_over": 4, "dilation_size": 2} | options
    kinds = ", ".join([f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in (*times, *space)] + [f"`{value}` double"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        from s2cloudless import S2PixelCloudDetector

        grids = pdf.pivot(index=space[0], columns=space[1])
        cubes = [grids[b].to_numpy(dtype=float) for b in S2_BANDS]
        import numpy as np

        image = np.nan_to_num(np.stack(cubes, axis=-1))[None]
        if image.max() > 10:
            image = image / 10000.0
        found = S2PixelCloudDetector(all_bands=False, **settings).get_cloud_probability_maps(image)[0].clip(0, 1)
        out = pd.DataFrame(found, index=grids.index, columns=grids[S2_BANDS[0]].columns).stack().rename(value).reset_index()
        for t in times:
            out[t] = pdf[t].iloc[0]
        return out[[*times, *space, value]]

    df = flat.groupBy(*times).applyInPandas(work, kinds).withColumn(bands_dim, F.lit("cloud"))
    return cube.of(df.select(*cube.schema.names, value), cube.schema.with_dim(Dim(bands_dim, "bands", ("cloud",))))
