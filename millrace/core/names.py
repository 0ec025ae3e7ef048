"""Column names: matched without regard to case, quoted for use in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def resolve(df: DataFrame, name: str) -> str:
    """The column's own spelling; KeyError if there is none."""
    low = name.lower()
    for c in df.columns:
        if c.lower() == low:
            return c
    raise KeyError(name)


def resolve_all(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [resolve(df, n) for n in names]


def missing(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [n for n in names if n.lower() not in have]
