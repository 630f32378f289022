"""Rasters on another grid, or in another coordinate system."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import DataCube
from ..functions.crs import normal, transform, transform_bbox
from ..schema import Dim
from .axes import Axis, attach, labelled

AGGREGATING = {
    "average": F.avg,
    "mode": lambda v: F.mode(v, True),
    "max": F.max,
    "min": F.min,
    "med": F.median,
    "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75),
    "sum": F.sum,
    "rms": lambda v: F.sqrt(F.avg(v * v)),
}


def _cubic(d: float) -> float:
    a = -0.5
    d = abs(d)
    if d < 1:
        return (a + 2) * d**3 - (a + 3) * d**2 + 1
    return a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0.0


def _spline(d: float) -> float:
    d = abs(d)
    if d < 1:
        return (4 - 6 * d**2 + 3 * d**3) / 6
    return (2 - d) ** 3 / 6 if d < 2 else 0.0


def _lanczos(d: float) -> float:
    d = abs(d)
    if d < 1e-12:
        return 1.0
    return 3 * math.sin(math.pi * d) * math.sin(math.pi * d / 3) / (math.pi * d) ** 2 if d < 3 else 0.0


#: Weight by distance in cells, and its reach.
INTERPOLATING = {"bilinear": (lambda d: max(0.0, 1 - abs(d)), 1), "cubic": (_cubic, 2), "cubicspline": (_spline, 2), "lanczos": (_lanczos, 3)}
METHODS = ("near", *INTERPOLATING, *AGGREGATING)


def grid(labels: list[float], resolution: float, descending: bool) -> list[float]:
    """Centres of the target cells, from the source's outer edge: the left, or the top of a descending axis."""
    step = abs(labels[1] - labels[0]) if len(labels) > 1 else resolution
    lo, hi = min(labels) - step / 2, max(labels) + step / 2
    n = max(1, math.ceil((hi - lo) / resolution - 1e-9))
    return [hi - (i + 0.5) * resolution for i in range(n)] if descending else [lo + (i + 0.5) * resolution for i in range(n)]


def axis_weights(labels: list[float], targets: list[float], method: str) -> Axis:
    """Targets of each source place: one for bins and the nearest, several with weights for the interpolating methods."""
    n = len(labels)
    step = (labels[-1] - labels[0]) / (n - 1) if n > 1 else 1.0
    first = labels[0]
    out: Axis = {}
    if method in AGGREGATING:
        size = abs(targets[1] - targets[0]) if len(targets) > 1 else abs(targets[0] - first) * 2 + abs(step) * n
        lo = min(targets) - size / 2
        order = sorted(range(len(targets)), key=lambda i: targets[i])
        for i, v in enumerate(labels):
            k = min(max(int(math.floor((v - lo) / size)), 0), len(targets) - 1)
            out[i] = [(order[k], 1.0)]
        return out
    ratio = max(1.0, abs(targets[1] - targets[0]) / abs(step)) if len(targets) > 1 else 1.0
    for t, c in enumerate(targets):
        at = (c - first) / step  # in cells from the first centre
        if method == "near":
            out.setdefault(min(max(math.floor(at + 0.5), 0), n - 1), []).append((t, 1.0))
            continue
        weight, reach = INTERPOLATING[method]
        for s in range(math.ceil(at - reach * ratio), math.floor(at + reach * ratio) + 1):
            w = weight((s - at) / ratio)
            if 0 <= s < n and w != 0:
                out.setdefault(s, []).append((t, w))
    return out


def resample_spatial(cube: DataCube, *, resolution=0, projection=None, method: str = "near", align: str = "upper-left", x_dim: str = "longitude", y_dim: str = "latitude") -> DataCube:
    """A coarser or finer grid, and another coordinate system first; other dimensions are grouping keys.

    Nothing happens without a resolution and a projection.  A resolution is a number or (x, y).  The grid starts at
    the outer upper-left edge; ``align`` changes nothing.  Weights are normalised over cells with data; when it gets
    coarser the interpolating methods reach as much further.
    """
    cube.need_raster()
    if not resolution and projection is None:
        return cube
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {METHODS}")
    if projection is not None and normal(projection) != normal(cube.schema.crs or 4326):
        cube = reproject(cube, projection, method if method in ("near", "bilinear") else "near", x_dim, y_dim)
    if not resolution:
        return cube
    rx, ry = (float(resolution[0]), float(resolution[1])) if isinstance(resolution, (list, tuple)) else (float(resolution),) * 2
    xs, ys = cube.labels(x_dim), cube.labels(y_dim)
    down = len(ys) > 1 and (cube.schema.dim(y_dim).labels is None or ys[0] > ys[-1])
    ys = sorted(ys, reverse=down)
    tx, ty = grid(xs, rx, False), grid(ys, ry, down)
    value, keys = cube.schema.value, cube.schema.others(x_dim, y_dim)
    df = attach(cube.df, y_dim, ys, axis_weights(ys, ty, method), "__y").drop(y_dim)
    df = attach(df, x_dim, xs, axis_weights(xs, tx, method), "__x").drop(x_dim)
    v = F.col(value).cast("double")
    if method in AGGREGATING:
        out = AGGREGATING[method](v)
    elif method == "near":
        out = F.max(v)  # one source cell for each target
    else:
        w = F.when(v.isNotNull(), F.col("__y_w") * F.col("__x_w"))
        out = F.try_divide(F.sum(v * w), F.sum(w))
    got = df.groupBy(*keys, "__y", "__x").agg(out.alias(value))
    got = labelled(labelled(got, "__y", ty, y_dim), "__x", tx, x_dim)
    schema = cube.schema.with_dim(Dim(x_dim, "x", tuple(tx))).with_dim(Dim(y_dim, "y", tuple(ty)))
    return cube.of(got.select(*cube.schema.names, value), schema)


def reproject(cube: DataCube, projection, method: str = "near", x_dim: str = "longitude", y_dim: str = "latitude") -> DataCube:
    """The cube on a grid of as many cells over its envelope in another system.

    Each target cell's centre goes back to the source's system; the cell that holds it gives its value, or the four
    around it by their nearness.  Targets outside the source have no row.
    """
    source, target = normal(cube.schema.crs or 4326), normal(projection)
    xs, ys = sorted(map(float, cube.labels(x_dim))), sorted(map(float, cube.labels(y_dim)))
    dx = (xs[-1] - xs[0]) / (len(xs) - 1) if len(xs) > 1 else 1.0
    dy = (ys[-1] - ys[0]) / (len(ys) - 1) if len(ys) > 1 else 1.0
    w, s, e, n = transform_bbox((xs[0] - dx / 2, ys[0] - dy / 2, xs[-1] + dx / 2, ys[-1] + dy / 2), source, target)
    tx = [w + (i + 0.5) * (e - w) / len(xs) for i in range(len(xs))]
    ty = [n - (i + 0.5) * (n - s) / len(ys) for i in range(len(ys))]
    spark, value, keys = cube.df.sparkSession, cube.schema.value, cube.schema.others(x_dim, y_dim)
    cells = spark.createDataFrame([(v,) for v in ty], "`__ty` double").withColumn("__tx", F.explode(F.array(*[F.lit(v) for v in tx])))
    x, y = transform(F.col("__tx"), F.col("__ty"), target, source)
    px, py = (x - xs[0]) / dx, (y - ys[0]) / dy
    table = lambda labels, name: spark.createDataFrame(list(enumerate(labels)), f"`__i{name}` int, `__l{name}` double")
    if method == "near":
        cells = cells.withColumn("__ix", F.floor(px + 0.5).cast("int")).withColumn("__iy", F.floor(py + 0.5).cast("int")).withColumn("__w", F.lit(1.0))
    else:
        cells = cells.withColumn("__px", px).withColumn("__py", py)
        near = lambda p: F.explode(F.array(F.floor(p).cast("int"), (F.floor(p) + 1).cast("int")))
        cells = cells.withColumn("__ix", near(F.col("__px"))).withColumn("__iy", near(F.col("__py")))
        weight: Column = (1 - F.abs(F.col("__px") - F.col("__ix"))) * (1 - F.abs(F.col("__py") - F.col("__iy")))
        cells = cells.withColumn("__w", weight).where("__w > 0")
    cells = cells.join(F.broadcast(table(xs, "x")), "__ix").join(F.broadcast(table(ys, "y")), "__iy").select("__tx", "__ty", "__w", "__lx", "__ly")
    got = cube.df.join(cells, (F.col(x_dim) == F.col("__lx")) & (F.col(y_dim) == F.col("__ly"))).drop(x_dim, y_dim)
    v = F.col(value).cast("double")
    wv = F.when(v.isNotNull(), F.col("__w"))
    got = got.groupBy(*keys, F.col("__tx").alias(x_dim), F.col("__ty").alias(y_dim)).agg(F.try_divide(F.sum(v * wv), F.sum(wv)).alias(value))
    schema = replace(cube.schema.with_dim(Dim(x_dim, "x", tuple(tx))).with_dim(Dim(y_dim, "y", tuple(ty))), crs=target)
    return cube.of(got.select(*cube.schema.names, value), schema)
