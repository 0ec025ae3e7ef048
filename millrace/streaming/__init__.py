"""Operators on streams."""

from .apply import ROW_WISE, by_batch, on_stream

__all__ = ["ROW_WISE", "by_batch", "on_stream"]
