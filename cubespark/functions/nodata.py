"""No-data is NULL: NaN becomes NULL on the way in, and aggregates either skip it or pass it on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(col: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(col), col)


def propagate(value: Column, result: Column) -> Column:
    """``result`` where no row of the group is NULL, else NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), result)
