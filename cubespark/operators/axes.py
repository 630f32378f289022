"""Weights along an axis: which cell of the new axis each old cell goes to, and how much it counts there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Axis = dict[int, list[tuple[int, float]]]


def attach(df: DataFrame, dim: str, labels: list, axis: Axis, name: str, extra: str = "double") -> DataFrame:
    """``df`` with a row for each target of its cell along ``dim``: ``<name>`` (the place) and ``<name>_w``.

    ``labels``: the axis in order.  The table that is broadcast has a row for each of its labels.
    """
    rows = [(float(v), [(int(t), float(w)) for t, w in axis.get(i, [])]) for i, v in enumerate(labels)]
    table = df.sparkSession.createDataFrame(rows, f"`__l` double, `__t` array<struct<t:int,w:{extra}>>")
    out = df.join(F.broadcast(table), F.col(dim).cast("double") == F.col("__l")).withColumn("__e", F.explode("__t"))
    return out.withColumn(name, F.col("__e.t")).withColumn(f"{name}_w", F.col("__e.w")).drop("__l", "__t", "__e")


def labelled(df: DataFrame, name: str, labels: list, dim: str) -> DataFrame:
    """``df`` with the label of each place."""
    table = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(labels)], f"`__i` int, `{dim}` double")
    return df.join(F.broadcast(table), F.col(name) == F.col("__i")).drop("__i", name)
