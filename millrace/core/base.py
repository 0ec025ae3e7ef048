"""The base of all operators: options are checked against the input, then applied."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import names
from .errors import ValidationError


class Operator:
    """Call it on a DataFrame, or hand it to ``DataFrame.transform``."""

    def problems(self, df: DataFrame) -> list[str]:
        """Everything wrong with the options for this input."""
        return []

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        if found := self.problems(df):
            raise ValidationError(type(self).__name__, found)
        return self.apply(df)


def absent(df: DataFrame, columns, what: str = "column") -> list[str]:
    return [f"{what} {n!r} is not in the input" for n in names.missing(df, [c for c in columns if c])]


def needed(value, what: str) -> list[str]:
    return [] if value else [f"{what} is required"]
