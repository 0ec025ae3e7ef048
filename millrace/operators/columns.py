"""Operators on the set of columns: select, edit, rename, unpivot, union."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import names
from ..core.base import Operator, absent, needed
from ..core.errors import ValidationError

KINDS: dict[str, tuple[type, ...]] = {
    "boolean": (T.BooleanType,), "string": (T.StringType, T.CharType, T.VarcharType), "integer": (T.IntegerType,), "short": (T.ShortType,), "byte": (T.ByteType,),
    "long": (T.LongType,), "float": (T.FloatType,), "double": (T.DoubleType,), "decimal": (T.DecimalType,), "binary": (T.BinaryType,), "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType), "struct": (T.StructType,),
    "int": (T.IntegerType,), "smallint": (T.ShortType,), "tinyint": (T.ByteType,), "bigint": (T.LongType,),
}


def over_columns(df: DataFrame, columns: Sequence[str], result: Column) -> dict[str, object]:
    """``result`` evaluated once a column, over a table of the columns' metadata."""
    at = {c: i for i, c in enumerate(df.columns)}
    rows = [(c, df.schema[at[c]].dataType.simpleString(), at[c]) for c in columns]
    meta = df.sparkSession.createDataFrame(rows, "column_name string, column_type string, field_number int")
    return {r[0]: r[1] for r in meta.select("column_name", result.alias("_r")).collect()}


@dataclass(frozen=True)
class DynamicSelect(Operator):
    """Selects columns by type, or by an expression over their metadata.

    The expression sees ``column_name``, ``column_type`` and ``field_number``
    (from 0).  If none match, the output is one null column, a row an input row.
    """

    types: Sequence[str] = ()
    using: str = "SELECT_FIELD_TYPES"
    expression: str = ""

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.expression, "expression") if self.using == "SELECT_EXPR" else needed(self.types, "at least one type")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.using == "SELECT_EXPR":
            hits = over_columns(df, df.columns, F.expr(self.expression))
            chosen = [c for c in df.columns if hits[c] is True or str(hits[c]).lower() == "true"]
        else:
            wanted = {t.lower() for t in self.types}
            classes = tuple(k for t in wanted for k in KINDS.get(t, ()))
            full = lambda f: {f.dataType.simpleString().lower(), f.dataType.simpleString().lower().split("(")[0]}
            chosen = [f.name for f in df.schema if isinstance(f.dataType, classes) or full(f) & wanted]
        if not chosen:
            return df.select(F.lit(None).cast("string").alias("no_columns_matched"))
        return df.select([names.col(c) for c in chosen])


@dataclass(frozen=True)
class MultiColumnEdit(Operator):
    """Applies one expression to many columns, in place or beside them.

    ``column_value`` in it is the column, ``column_name`` its name as a string.
    """

    columns: Sequence[str]
    expression: str
    rename: bool = False
    affix_option: str = "Prefix"
    affix: str = ""

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.columns, "at least one column") + needed(self.expression, "expression") + (needed(self.affix, "prefix or suffix") if self.rename else []) + absent(df, self.columns)

    def _edited(self, name: str) -> Column:
        literal = "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
        tokens = {"column_value": names.quoted(name), "column_name": literal}
        return F.expr(re.sub(r"\b(column_value|column_name)\b", lambda m: tokens[m[1]], self.expression))

    def apply(self, df: DataFrame) -> DataFrame:
        own = names.resolve_all(df, self.columns)
        if not self.rename:
            return df.select([self._edited(c).alias(c) if c in own else names.col(c) for c in df.columns])
        named = lambda c: self.affix + c if self.affix_option.lower() == "prefix" else c + self.affix
        return df.select("*", *[self._edited(c).alias(named(c)) for c in df.columns if c in own])


@dataclass(frozen=True)
class MultiColumnRename(Operator):
    """Renames columns by prefix, suffix, or an expression over ``column_name``."""

    columns: Sequence[str]
    method: str = "editPrefixSuffix"
    edit_type: str = "Prefix"
    edit_with: str = ""
    expression: str = ""

    def problems(self, df: DataFrame) -> list[str]:
        advanced = self.method == "advancedRename"
        more = needed(self.expression, "expression") if advanced else needed(self.edit_with, "prefix or suffix")
        return needed(self.columns, "at least one column") + more + absent(df, self.columns)

    def apply(self, df: DataFrame) -> DataFrame:
        own = names.resolve_all(df, self.columns)
        if self.method == "advancedRename":
            new = {k: str(v) for k, v in over_columns(df, own, F.expr(self.expression)).items()}
        else:
            new = {c: self.edit_with + c if self.edit_type.lower() == "prefix" else c + self.edit_with for c in own}
        return df.select([names.col(c).alias(new.get(c, c)) for c in df.columns])


@dataclass(frozen=True)
class Transpose(Operator):
    """Data columns to (name, value) rows, values as strings, nulls kept.

    One pass over the input, whatever the number of columns.
    """

    keys: Sequence[str]
    data: Sequence[str]
    name: str = "Name"
    value: str = "Value"

    def problems(self, df: DataFrame) -> list[str]:
        return absent(df, [*self.keys, *self.data])

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.data or not self.name or not self.value:
            return df
        keys, data = names.resolve_all(df, self.keys), names.resolve_all(df, self.data)
        # Positions stand for the keys' names, so that a column may be key and data at once.
        at = [f"_millrace_k{i}" for i in range(len(keys))]
        step = df.select(*[names.col(c).alias(k) for c, k in zip(keys, at, strict=True)], *[names.col(c).cast("string").alias(c) for c in data])
        step = step.unpivot([F.col(k) for k in at], [names.col(c) for c in data], "_millrace_n", "_millrace_v")
        return step.select(*[F.col(k).alias(c) for c, k in zip(keys, at, strict=True)], F.col("_millrace_n").alias(self.name), F.col("_millrace_v").alias(self.value))


@dataclass(frozen=True)
class UnionByName:
    """Stacks two or more inputs by column name, without regard to case.

    ``allowMissingColumns`` fills with nulls, first spelling and order first;
    ``nameBasedUnionOperation`` asks for equal sets of names.
    """

    operation: str = "allowMissingColumns"

    def __call__(self, *inputs: DataFrame) -> DataFrame:
        problems = [] if len(inputs) > 1 else ["at least two inputs are required"]
        if self.operation not in ("allowMissingColumns", "nameBasedUnionOperation"):
            problems.append(f"unknown operation {self.operation!r}")
        if not problems and self.operation == "nameBasedUnionOperation":
            first = {c.lower(): c for c in inputs[0].columns}
            for i, df in enumerate(inputs[1:], 2):
                here = {c.lower(): c for c in df.columns}
                extra, gone = [here[c] for c in here if c not in first], [first[c] for c in first if c not in here]
                if extra or gone:
                    problems.append(f"input {i}: extra columns {extra}, missing columns {gone}")
        if problems:
            raise ValidationError("UnionByName", problems)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
