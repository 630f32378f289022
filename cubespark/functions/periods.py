"""Calendar periods: labels of timestamps, and the labels between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _season(t: Column) -> Column:
    m = F.month(t)
    name = F.when(m.isin(12, 1, 2), "djf").when(m.isin(3, 4, 5), "mam").when(m.isin(6, 7, 8), "jja").otherwise("son")
    return F.concat_ws("-", (F.year(t) + F.when(m == 12, 1).otherwise(0)).cast("string"), name)


def _tropical(t: Column) -> Column:
    m = F.month(t)
    dry = m.isin(11, 12, 1, 2, 3, 4)
    return F.concat_ws("-", (F.year(t) - F.when(m <= 4, 1).otherwise(0)).cast("string"), F.when(dry, "ndjfma").otherwise("mjjaso"))


def _dekad(t: Column) -> Column:
    day = F.dayofmonth(t)
    part = F.when(day <= 10, 1).when(day <= 20, 2).otherwise(3)
    return F.concat_ws("-", F.year(t).cast("string"), _two((F.month(t) - 1) * 3 + part))


def _week(t: Column) -> Column:
    return F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), t).cast("string"), _two(F.weekofyear(t)))


LABELS = {
    "hour": lambda t: F.date_format(t, "yyyy-MM-dd-HH"),
    "day": lambda t: F.date_format(t, "yyyy-DDD"),
    "week": _week,
    "dekad": _dekad,
    "month": lambda t: F.date_format(t, "yyyy-MM"),
    "season": _season,
    "tropical-season": _tropical,
    "year": lambda t: F.date_format(t, "yyyy"),
    "decade": lambda t: (F.floor(F.year(t) / 10) * 10).cast("string"),
    "decade-ad": lambda t: (F.floor((F.year(t) - 1) / 10) * 10 + 1).cast("string"),
}

#: Periods whose empty bins between the first and the last appear, with no-data: their start and step.
REGULAR = {
    "hour": (lambda t: F.date_trunc("hour", t), "interval 1 hour"),
    "day": (lambda t: F.date_trunc("day", t), "interval 1 day"),
    "week": (lambda t: F.date_trunc("week", t), "interval 7 days"),
    "month": (lambda t: F.date_trunc("month", t), "interval 1 month"),
    "season": (lambda t: F.date_trunc("month", F.add_months(t, -(F.month(t) % 3))), "interval 3 months"),
    "year": (lambda t: F.date_trunc("year", t), "interval 1 year"),
}


def label(period: str, t: Column) -> Column:
    if period not in LABELS:
        raise ValueError(f"unknown period {period!r}; there are {sorted(LABELS)}")
    return LABELS[period](t)


def bins(period: str, first: Column, last: Column) -> Column:
    """The labels of all bins of a regular period from the one of ``first`` to the one of ``last``."""
    start, step = REGULAR[period]
    stamps = F.sequence(start(first).cast("timestamp"), start(last).cast("timestamp"), F.expr(step))
    return F.transform(stamps, LABELS[period])
