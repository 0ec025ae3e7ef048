"""Generated rows: a start value, a step and a condition."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import names
from ..core.base import Operator, needed
from ..core.errors import ValidationError
from ..core.literals import guessed

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DEFAULT_ROWS = 100
CHUNK = 256


@dataclass(frozen=True)
class GenerateRows(Operator):
    """Values ``init``, ``step(init)``, ... for as long as ``condition`` holds.

    All three are SQL expressions; the last two see the value by ``name``, and all
    see the input's columns as ``payload.<column>``.  Without an input there is one
    series, with one there is a series a row, beside its columns; a column of the
    same name gives way.  A series has ``max_rows`` values at most (100 if that is
    not a positive number).

    Counting up or down by a whole number to a bound is a ``sequence``.  Any other
    loop folds over arrays in chunks, inside one row: no shuffle either way.
    """

    init: str
    condition: str
    step: str
    name: str = "value"
    max_rows: int | None = None

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.init, "init") + needed(self.condition, "condition") + needed(self.step, "step") + needed(self.name, "name")

    def __call__(self, source: DataFrame | SparkSession) -> DataFrame:
        if isinstance(source, DataFrame):
            return super().__call__(source)
        if found := self.problems(source.range(0)):
            raise ValidationError("GenerateRows", found)
        return self.apply(source.range(1)).select(names.col(self.name))

    def _most(self) -> int:
        try:
            if self.max_rows is None or (most := int(self.max_rows)) <= 0:
                raise ValueError
        except ValueError:
            if self.max_rows not in (None, ""):
                warnings.warn(f"max_rows {self.max_rows!r} is not a positive number; {DEFAULT_ROWS} is used", stacklevel=3)
            return DEFAULT_ROWS
        return most

    def apply(self, df: DataFrame) -> DataFrame:
        seeded = df.select(F.struct(*[names.col(c) for c in df.columns]).alias("payload")).withColumn("_millrace_init", guessed(self.init))
        named = seeded.withColumn(self.name, F.col("_millrace_init"))
        kind = named.select(F.coalesce(names.col(self.name), F.expr(self.step)).alias("v")).schema["v"].dataType
        series = self._counted(named, kind)
        if series is None:
            series = F.expr(self._folded(kind.simpleString()))
        out = seeded.select("payload", F.explode(series).alias("_millrace_v"))
        kept = [F.col("payload")[c].alias(c) for c in df.columns if c.lower() != self.name.lower()]
        return out.select(*kept, F.col("_millrace_v").cast(kind).alias(self.name))

    def _counted(self, named: DataFrame, kind: T.DataType) -> Column | None:
        """The series as a sequence, if it counts to a bound that does not move."""
        word = rf"`?{re.escape(self.name)}`?"
        by = re.fullmatch(rf"\s*{word}\s*([+-])\s*(\d{{1,9}})\s*", self.step)
        to = re.fullmatch(rf"\s*{word}\s*(<=|>=|<|>)\s*(.+?)\s*", self.condition, re.S)
        if not by or not to or not isinstance(kind, WHOLE) or re.search(rf"\b{re.escape(self.name)}\b|\b(and|or|not|is|in|between|like)\b|[<>=!]", to[2], re.I):
            return None
        step = int(by[1] + by[2])
        if not step or (step > 0) != (to[1][0] == "<") or not isinstance(named.select(F.expr(to[2]).alias("v")).schema["v"].dataType, WHOLE):
            return None
        start, bound = F.col("_millrace_init").cast("decimal(38,0)"), F.expr(to[2]).cast("decimal(38,0)")
        room = (bound - start) * F.lit(1 if step > 0 else -1) - F.lit(0 if to[1][1:] else 1)
        n = F.least(F.lit(self._most()), F.floor(room / F.lit(abs(step))) + 1)
        values = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.col("_millrace_init") + i * F.lit(step))
        return F.when((room >= 0) & (n > 0), values)

    def _folded(self, kind: str) -> str:
        """The series as SQL: chunks of a bounded length, then the chunks together.

        Lambda variables carry the value's own name, so no text is rewritten; each
        chunk starts from where the one before stopped.
        """
        v, most = names.quoted(self.name), self._most()
        size = min(CHUNK, most)
        let = lambda value, of, body: f"element_at(transform(array({value}), {of} -> {body}), 1)"
        grown = let("_t.v", v, f"if(coalesce({self.condition}, false) AND _t.n < {most}, named_struct('out', concat(_t.out, array({v})), 'v', cast({self.step} AS {kind}), 'n', _t.n + 1, 'go', true), named_struct('out', _t.out, 'v', {v}, 'n', _t.n, 'go', false))")
        chunk = f"aggregate(sequence(1, {size}), named_struct('out', cast(array() AS array<{kind}>), 'v', _s.v, 'n', _s.n, 'go', _s.go), (_t, _j) -> if(_t.go, {grown}, _t))"
        together = let(chunk, "_c", "named_struct('out', concat(_s.out, array(_c.out)), 'v', _c.v, 'n', _c.n, 'go', _c.go)")
        start = f"named_struct('out', cast(array() AS array<array<{kind}>>), 'v', cast(_millrace_init AS {kind}), 'n', 0, 'go', true)"
        return f"aggregate(sequence(1, {-(-most // size)}), {start}, (_s, _i) -> if(_s.go, {together}, _s), _s -> flatten(_s.out))"
