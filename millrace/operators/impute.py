"""Imputation of nulls or of a sentinel value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import names
from ..core.base import Operator, absent, needed
from ..core.literals import typed

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Imputation(Operator):
    """Puts a statistic of the column, or a value, for nulls or for a sentinel.

    ``method``: average, median (an element of the column), mode (the smallest of
    the most frequent) or user_value.  With ``sentinel`` set, that value is put
    away and not counted; nulls stay.  ``keep_original`` writes ``<c>_ImputedValue``
    instead, and ``indicator`` adds ``<c>_Indicator``.

    All columns' statistics are one aggregate, and that one row is joined back.
    """

    columns: Sequence[str]
    method: str = "average"
    sentinel: Any = None
    user_value: Any = None
    keep_original: bool = False
    indicator: bool = False

    def problems(self, df: DataFrame) -> list[str]:
        out = needed(self.columns, "at least one column") + absent(df, self.columns)
        if self.method not in ("average", "median", "mode", "user_value"):
            out.append(f"unknown method {self.method!r}")
        if self.method == "user_value" and self.user_value is None:
            out.append("user_value is required")
        for c in self.columns if not out else ():
            if self.method in ("average", "median") and not isinstance(df.schema[names.resolve(df, c)].dataType, T.NumericType):
                out.append(f"column {c!r} is not numeric")
        return out

    def _statistic(self, c: Column, kind: T.DataType) -> Column:
        kept = c if self.sentinel is None else F.when(c.isNull() | (c != typed(self.sentinel, kind)), c)
        value = {"average": lambda: F.avg(kept), "median": lambda: F.percentile_approx(kept, 0.5), "mode": lambda: F.mode(kept, True)}[self.method]()
        # An average of whole numbers is cut, not rounded.
        return value.cast(kind)

    def apply(self, df: DataFrame) -> DataFrame:
        own = names.resolve_all(df, self.columns)
        kinds = {c: df.schema[c].dataType for c in own}
        if self.method == "user_value":
            step, stat = df, {c: typed(self.user_value, kinds[c]) for c in own}
        else:
            stats = df.agg(*[self._statistic(names.col(c), kinds[c]).alias(f"_millrace_s{i}") for i, c in enumerate(own)])
            step, stat = df.crossJoin(F.broadcast(stats)), {c: F.col(f"_millrace_s{i}") for i, c in enumerate(own)}
        hit = {c: names.col(c).isNull() if self.sentinel is None else F.coalesce(names.col(c) == typed(self.sentinel, kinds[c]), F.lit(False)) for c in own}
        filled = {c: F.when(hit[c], stat[c]).otherwise(names.col(c)).cast(kinds[c]) for c in own}
        out = [filled[c].alias(c) if c in own and not self.keep_original else names.col(c) for c in df.columns]
        for c in own:
            out += [filled[c].alias(f"{c}_ImputedValue")] if self.keep_original else []
            out += [hit[c].cast("int").alias(f"{c}_Indicator")] if self.indicator else []
        return step.select(out)
