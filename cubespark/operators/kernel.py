"""Convolution with a small kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cube import DataCube
from ..errors import DimensionNotAvailable, KernelDimensionsUneven
from .axes import labelled

BORDERS = ("replicate", "reflect", "reflect_pixel", "wrap")


def border_index(i: int, n: int, border) -> int | None:
    """The place that stands for place ``i`` of an axis of ``n`` cells; None where a constant does."""
    if 0 <= i < n:
        return i
    if border == "replicate":
        return min(max(i, 0), n - 1)
    if border == "reflect":
        m = i % (2 * n)
        return m if m < n else 2 * n - 1 - m
    if border == "reflect_pixel":
        if n == 1:
            return 0
        m = i % (2 * n - 2)
        return m if m < n else 2 * n - 2 - m
    return i % n if border == "wrap" else None


def apply_kernel(cube: DataCube, *, kernel, factor: float = 1.0, border=0, replace_invalid: float = 0.0, x_dim: str = "longitude", y_dim: str = "latitude") -> DataCube:
    """True convolution: the kernel is flipped, and the sum is times ``factor``.

    Each cell is sent to the cells that it counts for, along one axis and then the other; sums are made before the
    shuffle too.  What is not finite counts as ``replace_invalid``.  Over the edge stands ``border``, a number or one
    of BORDERS.  The cube must be dense: a missing row counts as 0.
    """
    cube.need_raster()
    rows = [list(map(float, r)) for r in kernel]
    h, w = len(rows), len(rows[0]) if rows else 0
    if any(len(r) != w for r in rows) or h % 2 == 0 or w % 2 == 0:
        raise KernelDimensionsUneven("a kernel has an odd number of rows and of columns")
    for n in (x_dim, y_dim):
        if n not in cube.schema.names:
            raise DimensionNotAvailable(f"no dimension {n!r}")
    constant = float(border) if isinstance(border, (int, float)) and not isinstance(border, bool) else None
    if constant is None and border not in BORDERS:
        raise ValueError(f"unknown border {border!r}; there are numbers and {BORDERS}")
    cy, cx = h // 2, w // 2
    spark, value, keys = cube.df.sparkSession, cube.schema.value, cube.schema.others(x_dim, y_dim)

    def axis(name: str, half: int):
        """(label, [(target, kernel row or column)]), and for each target those over the edge."""
        labels = cube.labels(name)
        n = len(labels)
        to: dict[int, list[tuple[int, int]]] = {}
        over: list[list[int]] = [[] for _ in range(n)]
        for t in range(n):
            for d in range(-half, half + 1):
                s = border_index(t + d, n, border if constant is None else None)
                if s is None:
                    over[t].append(half - d)
                else:
                    to.setdefault(s, []).append((t, half - d))
        return labels, to, over

    ys, y_to, y_over = axis(y_dim, cy)
    xs, x_to, x_over = axis(x_dim, cx)

    def attach(df, dim, labels, to, name):
        table = spark.createDataFrame([(float(v), to.get(i, [])) for i, v in enumerate(labels)], "`__l` double, `__t` array<struct<t:int,k:int>>")
        out = df.join(F.broadcast(table), F.col(dim).cast("double") == F.col("__l")).withColumn("__e", F.explode("__t"))
        return out.withColumn(name, F.col("__e.t")).withColumn(f"{name}_k", F.col("__e.k")).drop("__l", "__t", "__e", dim)

    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    df = cube.df.withColumn(value, F.when(ok, v).otherwise(F.lit(float(replace_invalid))))
    df = attach(attach(df, y_dim, ys, y_to, "__y"), x_dim, xs, x_to, "__x")
    flat = F.array(*[F.lit(x) for r in rows for x in r])
    weight = F.element_at(flat, F.col("__y_k") * w + F.col("__x_k") + 1)
    out = df.groupBy(*keys, "__y", "__x").agg(F.sum(weight * F.col(value)).alias(value))
    if constant:
        # the constant's part: all weights less those whose row and column are both inside
        def inside(over, half):
            return [tuple(sorted(set(range(2 * half + 1)) - set(o))) for o in over]

        iy, ix = inside(y_over, cy), inside(x_over, cx)
        total = sum(map(sum, rows))
        part: dict[tuple, float] = {}
        for a in set(iy):
            for b in set(ix):
                part[a, b] = constant * (total - sum(rows[j][i] for j in a for i in b))
        ka, kb = {a: i for i, a in enumerate(sorted(set(iy)))}, {b: i for i, b in enumerate(sorted(set(ix)))}
        ty = spark.createDataFrame([(i, ka[a]) for i, a in enumerate(iy)], "`__iy` int, `__a` int")
        tx = spark.createDataFrame([(i, kb[b]) for i, b in enumerate(ix)], "`__ix` int, `__b` int")
        table = spark.createDataFrame([(ka[a], kb[b], p) for (a, b), p in part.items()], "`__a` int, `__b` int, `__p` double")
        out = out.join(F.broadcast(ty), F.col("__y") == F.col("__iy")).join(F.broadcast(tx), F.col("__x") == F.col("__ix")).join(F.broadcast(table), ["__a", "__b"])
        out = out.withColumn(value, F.col(value) + F.col("__p")).drop("__iy", "__ix", "__a", "__b", "__p")
    out = out.withColumn(value, F.col(value) * F.lit(float(factor)))
    out = labelled(labelled(out, "__y", ys, y_dim), "__x", xs, x_dim)
    return cube.of(out.select(*cube.schema.names, value))
