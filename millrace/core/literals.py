"""Literals of a column's own type."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = re.compile(r"'?(\d{4}-\d{2}-\d{2})'?")
TIMESTAMP = re.compile(r"'?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)'?")
TIMES = (T.TimestampType, T.TimestampNTZType)


def typed(value: Any, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def guessed(text: str) -> Column:
    """An SQL expression; a bare or quoted date or timestamp is one, by its shape."""
    if m := DATE.fullmatch(text.strip()):
        return F.lit(m[1]).cast("date")
    if m := TIMESTAMP.fullmatch(text.strip()):
        return F.lit(m[1]).cast("timestamp")
    return F.expr(text)


def is_date(text: str) -> bool:
    return _parses(text, "%Y-%m-%d")


def is_timestamp(text: str) -> bool:
    return _parses(text, "%Y-%m-%d %H:%M:%S.%f") or _parses(text, "%Y-%m-%d %H:%M:%S")


def _parses(text: str, form: str) -> bool:
    try:
        datetime.strptime(text, form)
    except (ValueError, TypeError):
        return False
    return True
