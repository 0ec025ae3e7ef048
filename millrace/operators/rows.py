"""Operators that number rows: running totals, ids, duplicates, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..core import names, ordering, prefix
from ..core.base import Operator, absent, needed

CONDITIONS = ("between", "equal_to", "not_equal_to", "less_than", "greater_than")


def windowed(df: DataFrame, groups: Sequence[str], order: Sequence, otherwise: Column | None = None) -> WindowSpec:
    """Partitioned by columns, ordered by rules, or by ``otherwise`` if there are none."""
    by = [names.col(c) for c in names.resolve_all(df, groups)]
    keys = ordering.columns(order) or [F.lit(1) if otherwise is None else otherwise]
    return Window.partitionBy(*by).orderBy(*keys)


def spreads(df: DataFrame, spread: bool | None) -> bool:
    return prefix.is_large(df) if spread is None else spread


def placed(df: DataFrame, order: Sequence, name: str, spread: bool | None) -> DataFrame:
    """``df`` with ``name`` from 1 in ``order`` over the whole table."""
    made = prefix.running(df, order, {name: F.lit(1).cast("long")}) if order and spreads(df, spread) else None
    return df.withColumn(name, F.row_number().over(windowed(df, (), order))) if made is None else made


def placed_in(df: DataFrame, groups: Sequence[str], order: Sequence, name: str, spread: bool | None) -> DataFrame:
    """``df`` with ``name`` from 1 in ``order`` within each group."""
    made = prefix.within(df, groups, order, {name: F.lit(1).cast("long")}) if order and spreads(df, spread) else None
    return df.withColumn(name, F.row_number().over(windowed(df, groups, order))) if made is None else made


@dataclass(frozen=True)
class RunningTotal(Operator):
    """Sums of columns from the first row of the group up to each row; null is 0.

    All totals share one window, so one shuffle and one sort.  Totals over a whole
    large table, and over its hot groups, are made in bins of the first order key (see ``core.prefix``);
    ``spread`` sets that, else the table's size decides.
    """

    columns: Sequence[str]
    group_by: Sequence[str] = ()
    order_by: Sequence = ()
    prefix: str = "RunTot_"
    spread: bool | None = None

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.columns, "at least one column") + absent(df, [*self.columns, *self.group_by]) + ordering.problems(self.order_by)

    def apply(self, df: DataFrame) -> DataFrame:
        own = names.resolve_all(df, self.columns)
        if (self.order_by or not self.group_by) and spreads(df, self.spread):
            sums = {f"_millrace_t{i}": F.coalesce(names.col(c), F.lit(0)) for i, c in enumerate(own)}
            if self.group_by:
                made = prefix.within(df, names.resolve_all(df, self.group_by), self.order_by, sums)
            else:
                made = prefix.running(df, self.order_by, sums) if self.order_by else prefix.by_partition(df, sums)
            if made is not None:
                return made.select(*[names.col(c) for c in df.columns], *[F.col(f"_millrace_t{i}").alias(f"{self.prefix}{c}") for i, c in enumerate(own)])
        w = windowed(df, self.group_by, self.order_by, F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(F.coalesce(names.col(c), F.lit(0))).over(w).alias(f"{self.prefix}{c}") for c in own])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` from 1, in no set order, without one task for all rows.

    Partitions are counted, and each row's number is its place in its partition
    after the rows of the partitions before: counts, not rows, meet in one task.
    """
    part, place = "_millrace_part", "_millrace_place"
    # The id has the partition in its upper bits and the place in its lower 33.
    step = df.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33))
    counts = step.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # The input is read twice; should its partitions differ between the two, it raises.
    joined = step.join(offsets, F.col(part) == F.col("_p"), "left")
    found = F.when(F.col("_p").isNull(), F.raise_error(F.lit("partitions changed between two reads"))).otherwise(F.lit(0))
    return joined.select(*[names.col(c) for c in df.columns], (F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1 + found).alias(name))


@dataclass(frozen=True)
class RecordID(Operator):
    """Adds a record id: ``incremental_id`` numbers, or ``uuid``.

    Numbers start at ``start``; as strings they are padded with zeros to ``size``
    digits, and cut to it when longer.  ``groupLevel`` numbers within groups.  No
    ordered or table-level form of it puts a large table into one task; ``spread`` is as for running totals.
    """

    method: str = "incremental_id"
    name: str = "RecordID"
    type: str = "string"
    size: int = 6
    start: int = 1000
    generation: str = "tableLevel"
    position: str = "first_column"
    group_by: Sequence[str] = ()
    order_by: Sequence = ()
    spread: bool | None = None

    def problems(self, df: DataFrame) -> list[str]:
        return needed(self.name, "name") + absent(df, self.group_by) + ordering.problems(self.order_by)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.method == "uuid":
            made, value = df, F.uuid()
        else:
            if self.generation != "groupLevel" and not self.order_by:
                made = numbered(df, "_millrace_n")
            elif self.generation == "groupLevel" and self.group_by:
                made = placed_in(df, self.group_by, self.order_by, "_millrace_n", self.spread)
            else:
                made = placed(df, self.order_by, "_millrace_n", self.spread) if self.order_by else numbered(df, "_millrace_n")
            value = F.col("_millrace_n").cast("long") + F.lit(self.start - 1)
            if self.type.lower() == "string":
                value = F.lpad(value.cast("string"), self.size, "0")
        rest = [names.col(c) for c in df.columns]
        ids = [value.alias(self.name)]
        return made.select(ids + rest if self.position == "first_column" else rest + ids)


@dataclass(frozen=True)
class FindDuplicates(Operator):
    """Rows by their place in, or the size of, the group of rows with equal keys.

    ``output``: unique (the first of each group), duplicate (all others),
    custom_row_number or custom_group_count, compared by ``condition`` with ``n``
    or with ``lower`` and ``upper``.  ``allCols`` takes all columns as keys.
    ``spread`` is as for running totals; the first of each group needs none, as
    Spark keeps one row a group before the shuffle.
    """

    columns: Sequence[str] = ()
    output: str = "unique"
    generation: str = "allCols"
    condition: str = ""
    n: int | None = None
    lower: int | None = None
    upper: int | None = None
    order_by: Sequence = ()
    spread: bool | None = None

    def problems(self, df: DataFrame) -> list[str]:
        out = ordering.problems(self.order_by)
        if self.generation != "allCols":
            out += needed(self.columns, "at least one column") + absent(df, self.columns)
        if self.output not in ("unique", "duplicate", "custom_row_number", "custom_group_count"):
            out.append(f"unknown output {self.output!r}")
        if self.output.startswith("custom"):
            if self.condition not in CONDITIONS:
                out.append(f"unknown condition {self.condition!r}")
            elif self.condition == "between":
                if self.lower is None or self.upper is None:
                    out.append("lower and upper are required")
                elif self.upper < self.lower:
                    out.append("upper is below lower")
            elif self.n is None:
                out.append("n is required")
        return out

    def _holds(self, x: Column) -> Column:
        return {
            "between": lambda: x.between(self.lower, self.upper),
            "equal_to": lambda: x == self.n,
            "not_equal_to": lambda: x != self.n,
            "less_than": lambda: x < self.n,
            "greater_than": lambda: x > self.n,
        }[self.condition]()

    def apply(self, df: DataFrame) -> DataFrame:
        every = self.generation == "allCols"
        if every and self.output == "unique":
            return df.dropDuplicates()
        keys = df.columns if every else self.columns
        if self.output == "custom_group_count":
            return self._by_count(df, names.resolve_all(df, keys))
        x = F.col("_millrace_n")
        keep = {"unique": lambda: x == 1, "duplicate": lambda: x > 1}.get(self.output, lambda: self._holds(x))()
        made = placed_in(df, keys, () if every else self.order_by, "_millrace_n", False if self.output == "unique" else self.spread)
        return made.filter(keep).drop("_millrace_n")

    def _by_count(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Counts combine map-side, and only the keys of the groups that are kept meet the rows again."""
        own = {c: f"_millrace_k{i}" for i, c in enumerate(keys)}
        counts = df.groupBy(*[names.col(c).alias(k) for c, k in own.items()]).agg(F.count(F.lit(1)).alias("_millrace_n"))
        kept = counts.filter(self._holds(F.col("_millrace_n"))).drop("_millrace_n")
        return df.join(kept, prefix.same([names.col(c) for c in own], list(own.values())), "left_semi")


@dataclass(frozen=True)
class Sample(Operator):
    """A sample of rows, of the whole table or of each group.

    Modes: firstN, lastN, skipN, oneOfN (the first of each n), oneInN (the last of
    each n), randomN, nPercent, randomNPercent.  The random modes go by a hash of
    the seed and the row, so they do not depend on how rows are laid out.
    """

    mode: str = "firstN"
    n: float = 80
    level: str = "sampleDataset"
    group_by: Sequence[str] = ()
    order_by: Sequence = ()
    seed: int = 1002
    spread: bool | None = None

    MODES = ("firstN", "lastN", "skipN", "oneOfN", "oneInN", "randomN", "nPercent", "randomNPercent")

    def problems(self, df: DataFrame) -> list[str]:
        out = absent(df, self.group_by) + ordering.problems(self.order_by)
        if self.mode not in self.MODES:
            out.append(f"unknown mode {self.mode!r}")
        if self.n is None or self.n < 0 or (self.mode in ("oneOfN", "oneInN") and self.n < 1):
            out.append("n is out of range")
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        groups = () if self.level == "sampleDataset" else names.resolve_all(df, self.group_by)
        draw = F.xxhash64(F.lit(self.seed), *[names.col(c).cast("string") for c in df.columns])
        rules, random = self.order_by, self.mode.startswith("random")
        if random:
            df = df.withColumn("_millrace_draw", draw)
            rules = ["_millrace_draw", *[f"cast({names.quoted(c)} AS string)" for c in df.columns[:-1]]]
        order = ordering.columns(rules)
        if not groups and self.mode in ("firstN", "randomN"):
            return (df.orderBy(*order) if order else df).limit(int(self.n)).drop("_millrace_draw")
        by = Window.partitionBy(*[names.col(c) for c in groups])
        rn, rows = F.col("_millrace_rn"), F.col("_millrace_rows")
        count = F.count(F.lit(1)).alias("_millrace_rows")
        counted = self.mode in ("lastN", "nPercent", "randomNPercent")
        if not groups:
            step = placed(df, rules, "_millrace_rn", self.spread) if order else numbered(df, "_millrace_rn")
            step = step.crossJoin(F.broadcast(df.agg(count))) if counted else step  # one row
        else:
            # Of the first n of a group Spark keeps n rows before the shuffle, so those need no bins.
            bins = order and self.mode not in ("firstN", "randomN") and spreads(df, self.spread)
            step = prefix.within(df, groups, rules, {"_millrace_rn": F.lit(1).cast("long")}) if bins else None
            if step is None:
                step = df.withColumn("_millrace_rn", F.row_number().over(by.orderBy(*(order or [names.col(c) for c in groups]))))
                step = step.withColumn("_millrace_rows", F.count(F.lit(1)).over(by)) if counted else step
            elif counted:
                own = [f"_millrace_g{i}" for i in range(len(groups))]
                each = df.groupBy(*[names.col(c).alias(g) for c, g in zip(groups, own, strict=True)]).agg(count)
                step = step.join(each, prefix.same([names.col(c) for c in groups], own)).drop(*own)
        n = int(self.n)
        if "Percent" in self.mode:
            keep = rn <= F.ceil(rows * F.lit(min(float(self.n), 100.0)) / F.lit(100.0))
        elif self.mode == "oneOfN":
            keep = F.pmod(rn - 1, F.lit(n)) == 0
        elif self.mode == "oneInN":
            keep = F.pmod(rn, F.lit(n)) == 0
        else:
            keep = {"firstN": rn <= n, "randomN": rn <= n, "skipN": rn > n, "lastN": rn > rows - n}.get(self.mode)
        return step.filter(keep).drop("_millrace_rn", "_millrace_rows", "_millrace_draw")


def percent_rows(rows: int, percent: float) -> int:
    """How many of ``rows`` the percent modes keep."""
    return math.ceil(rows * min(percent, 100.0) / 100.0)
