"""The calendar aggregation on streams."""

from .temporal import aggregate_stream

__all__ = ["aggregate_stream"]
