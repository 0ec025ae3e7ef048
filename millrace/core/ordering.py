"""Ordering rules: an expression and one of four sort types."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SORTS = ("asc", "asc_nulls_last", "desc", "desc_nulls_first")


@dataclass(frozen=True)
class OrderRule:
    """An SQL expression and a sort type; ``asc`` puts nulls first, ``desc`` last."""

    expression: str
    sort: str = "asc"

    def column(self) -> Column:
        e = F.expr(self.expression)
        return {"asc": e.asc_nulls_first, "asc_nulls_last": e.asc_nulls_last, "desc_nulls_first": e.desc_nulls_first}.get(self.sort, e.desc_nulls_last)()


def rules(order: Iterable[OrderRule | tuple[str, str] | str]) -> list[OrderRule]:
    """Rules, (expression, sort) pairs and bare expressions alike."""
    out = []
    for o in order:
        out.append(o if isinstance(o, OrderRule) else OrderRule(o) if isinstance(o, str) else OrderRule(*o))
    return out


def columns(order: Iterable) -> list[Column]:
    return [r.column() for r in rules(order)]


def problems(order: Iterable) -> list[str]:
    out = []
    for r in rules(order):
        if not r.expression.strip():
            out.append("an order rule has no expression")
        if r.sort not in SORTS:
            out.append(f"unknown sort type {r.sort!r}")
    return out
