"""Record counts and weighted averages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import names
from ..core.base import Operator, absent, needed


@dataclass(frozen=True)
class CountRecords(Operator):
    """Counts all records, or non-null or distinct values of columns.

    ``method``: count_all_records (also any unknown one), count_non_null_records
    or count_distinct_records.  ``approximate`` trades exact distinct counts for
    sketches of fixed size.
    """

    columns: Sequence[str] = ()
    method: str = "count_all_records"
    approximate: bool = False

    def problems(self, df: DataFrame) -> list[str]:
        if self.method == "count_non_null_records":
            return needed(self.columns, "at least one column") + absent(df, self.columns)
        return absent(df, self.columns) if self.method == "count_distinct_records" else []

    def apply(self, df: DataFrame) -> DataFrame:
        own = names.resolve_all(df, self.columns)
        if self.method == "count_non_null_records":
            return df.agg(*[F.count(names.col(c)).alias(f"{c}_count") for c in own])
        if self.method == "count_distinct_records" and own:
            count = F.approx_count_distinct if self.approximate else F.count_distinct
            return df.agg(*[count(names.col(c)).alias(f"{c}_distinct_count") for c in own])
        return df.agg(F.count(F.lit(1)).alias("total_records"))


@dataclass(frozen=True)
class WeightedAverage(Operator):
    """``sum(value * weight) / sum(weight)``, null where the weights sum to 0.

    Weights of rows with a null value count too.
    """

    value: str
    weight: str
    output: str = "WeightedAverage"
    group_by: Sequence[str] = ()

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.value, "value") + needed(self.weight, "weight") + needed(self.output, "output") + absent(df, [self.value, self.weight, *self.group_by])

    def apply(self, df: DataFrame) -> DataFrame:
        v, w = (names.col(names.resolve(df, x)) for x in (self.value, self.weight))
        groups = [names.col(c) for c in names.resolve_all(df, self.group_by)]
        return df.groupBy(*groups).agg((F.sum(v * w) / F.nullif(F.sum(w), F.lit(0))).alias(self.output))
