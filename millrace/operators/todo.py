"""An operator yet to be written, and the row assertion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.base import Operator, needed


@dataclass(frozen=True)
class ToDo(Operator):
    """Fails, with its message, when the result is computed."""

    message: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(F.raise_error(F.lit(f"ToDo: {self.message}")).isNull())


@dataclass(frozen=True)
class AssertExpression(Operator):
    """The rows for which a condition is false or null; none means that it holds.

    ``column`` puts the condition on one column: ``AssertExpression("> 0", "x")``.
    """

    expression: str
    column: str | None = None

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.expression, "expression")

    def apply(self, df: DataFrame) -> DataFrame:
        text = self.expression if self.column is None else f"{self.column} {self.expression}"
        return df.filter(~F.coalesce(F.expr(text), F.lit(False)))
