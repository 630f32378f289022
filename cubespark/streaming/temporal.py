"""Period aggregates of a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import label
from ..functions.reducers import SKIPPING

#: Periods that are windows of a fixed length, which a watermark can close.
WINDOWS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def aggregate_stream(cells: DataFrame, *, period: str = "hour", reducer: str = "mean", t_dim: str = "time", keys: list[str] | None = None, value: str = "value", delay: str = "1 hour") -> DataFrame:
    """Like ``aggregate_temporal`` on a streaming DataFrame: bins close ``delay`` after their end, late cells are dropped.

    Hours, days and weeks are event-time windows (append mode works); longer periods are keyed by their label
    (update or complete mode).  Empty bins do not appear.
    """
    if reducer not in SKIPPING or reducer == "median":
        raise ValueError(f"no streaming reducer {reducer!r}")
    x = cells.withWatermark(t_dim, delay)
    keys = keys or []
    result = SKIPPING[reducer](F.col(value)).alias(value)
    if period in WINDOWS:
        # windows of weeks start on Mondays: 1970-01-05
        w = F.window(t_dim, WINDOWS[period], WINDOWS[period], "4 days" if period == "week" else "0 seconds")
        out = x.groupBy(w.alias("__w"), *keys).agg(result)
        return out.select(label(period, F.col("__w.start")).alias(t_dim), *keys, value)
    return x.groupBy(label(period, F.col(t_dim)).alias(t_dim), *keys).agg(result)
