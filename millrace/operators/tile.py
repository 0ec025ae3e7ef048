"""Tiles: rows put in numbered classes by count, sum, deviation, value or cutoffs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..core import names, ordering, prefix
from ..core.base import Operator, absent, needed
from .rows import numbered, placed, placed_in, spreads

METHODS = ("equal_records", "equal_sum_tile", "smart_tile", "unique_value", "manual")
LABELS = {0: "Average", 1: "Above Average", 2: "High", 3: "Extremely High", -1: "Below Average", -2: "Low", -3: "Extremely Low"}


@dataclass(frozen=True)
class Tile(Operator):
    """Adds tile numbers within groups.

    equal_records: ``n`` tiles of equal counts; rows equal in ``no_split`` share
    one.  equal_sum_tile: ``n`` tiles of about equal sums of ``column``, numbered
    densely.  smart_tile: whole standard deviations from the mean; ``smart_output``
    adds labels (no_output_column_smartTile, output_column_smartTile, or verbose
    with bounds).  unique_value: a tile for each value of ``columns``.  manual: by
    rising ``cutoffs``, compared as 32-bit floats; beyond the last, and null, one more.

    Tiles of equal counts or sums over a whole large table, of equal counts within hot
    groups, and the places within hot tiles, are made in bins of the first order key (see ``core.prefix``); tiles of
    unique values, and those that do not split, are then numbered by one row a value.
    ``spread`` sets that, else the table's size decides.
    """

    method: str = "equal_sum_tile"
    column: str = ""
    columns: Sequence[str] = ()
    n: int = 1
    group_by: Sequence[str] = ()
    order_by: Sequence = ()
    no_split: Sequence[str] = ()
    cutoffs: Sequence[float] = ()
    smart_output: str = "no_output_column_smartTile"
    spread: bool | None = None

    def problems(self, df: DataFrame) -> list[str]:
        out = [] if self.method in METHODS else [f"unknown method {self.method!r}"]
        out += absent(df, [*self.group_by, *self.no_split, *self.columns, self.column]) + ordering.problems(self.order_by)
        if self.method in ("equal_records", "equal_sum_tile") and self.n < 1:
            out.append("n must be at least 1")
        if self.method in ("equal_sum_tile", "smart_tile", "manual"):
            out += needed(self.column, "column")
            if self.column and not out and not isinstance(df.schema[names.resolve(df, self.column)].dataType, T.NumericType):
                out.append(f"column {self.column!r} is not numeric")
        if self.method == "unique_value":
            out += needed(self.columns, "at least one column")
        if self.method == "manual":
            out += needed(self.cutoffs, "cutoffs")
            if any(b <= a for a, b in zip(self.cutoffs[:-1], self.cutoffs[1:], strict=True)):
                out.append("cutoffs must rise")
        return out

    def _by(self, df: DataFrame) -> list[Column]:
        return [names.col(c) for c in names.resolve_all(df, self.group_by)]

    def apply(self, df: DataFrame) -> DataFrame:
        return getattr(self, "_" + self.method.removesuffix("_tile"))(df, self._by(df))

    def _sequenced(self, df: DataFrame, order: Sequence, name: str = "Tile_SequenceNum") -> DataFrame:
        """``df`` with each row's place in its tile; in any order if there is none."""
        groups = [*names.resolve_all(df, self.group_by), "Tile_Num"]
        made = placed_in(df, groups, order, name, self.spread)
        return made.withColumn(name, F.col(name).cast("int"))

    def _by_place(self, df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
        """Tiles of equal counts from each row's number and the number of rows alone, of the table or of each group."""
        rn, n = F.col("_millrace_n"), F.lit(self.n)
        count = F.count(F.lit(1)).alias("_millrace_all")
        if groups:
            own = [f"_millrace_a{i}" for i in range(len(groups))]
            made = placed_in(df, groups, self.order_by, "_millrace_n", True)
            each = df.groupBy(*[names.col(c).alias(g) for c, g in zip(groups, own, strict=True)]).agg(count)
            made = made.join(each, prefix.same([names.col(c) for c in groups], own))
        else:
            made = placed(df, self.order_by, "_millrace_n", True) if self.order_by else numbered(df, "_millrace_n")
            made = made.crossJoin(F.broadcast(df.agg(count)))
        size, longer = F.floor(F.col("_millrace_all") / n), F.col("_millrace_all") % n
        edge = longer * (size + 1)
        tile = F.when(rn <= edge, F.ceil(rn / (size + 1))).otherwise(longer + F.ceil((rn - edge) / F.greatest(size, F.lit(1))))
        made = made.withColumn("Tile_Num", tile.cast("int"))
        before = F.when(F.col("Tile_Num") <= longer, (F.col("Tile_Num") - 1) * (size + 1)).otherwise(edge + (F.col("Tile_Num") - longer - 1) * size)
        rows = F.when(F.col("Tile_Num") <= longer, size + 1).otherwise(size)
        return made.select(*[names.col(c) for c in df.columns], "Tile_Num", rows.cast("long").alias("Tile_RecordCount"), (rn - before).cast("int").alias("Tile_SequenceNum"))

    def _equal_records(self, df: DataFrame, by: list[Column]) -> DataFrame:
        if (self.order_by or not by) and spreads(df, self.spread):
            groups = names.resolve_all(df, self.group_by)
            return self._together(df, groups) if self.no_split else self._by_place(df, groups)
        order = ordering.columns(self.order_by) or [F.lit(1)]
        step = df.withColumn("Tile_Num", F.ntile(self.n).over(Window.partitionBy(*by).orderBy(*order)))
        if self.no_split:
            together = [names.col(c) for c in names.resolve_all(df, self.no_split)]
            step = step.withColumn("_millrace_t", F.min("Tile_Num").over(Window.partitionBy(*by, *together)))
            step = step.withColumn("Tile_Num", F.dense_rank().over(Window.partitionBy(*by).orderBy("_millrace_t"))).drop("_millrace_t")
        count = F.count(F.lit(1)).over(Window.partitionBy(*by, "Tile_Num"))
        return self._sequenced(step.withColumn("Tile_RecordCount", count), self.order_by)

    def _together(self, df: DataFrame, groups: Sequence[str]) -> DataFrame:
        """Tiles of equal counts that do not split rows equal in ``no_split``, from one row for each such value.

        Ties of the order go by those columns, so that reading the input twice gives the same tiles.
        """
        apart = names.resolve_all(df, self.no_split)
        own = [*groups, *apart]
        placed_ = replace(self, no_split=(), order_by=[*self.order_by, *map(names.quoted, apart)])._by_place(df, groups)
        values = [f"_millrace_u{i}" for i in range(len(own))]
        each = placed_.groupBy(*[names.col(c).alias(v) for c, v in zip(own, values, strict=True)]).agg(F.min("Tile_Num").alias("_millrace_t"), F.count(F.lit(1)).alias("_millrace_n"))
        # At most n rows a group.
        of, inside = values[: len(groups)], [f"_millrace_v{i}" for i in range(len(groups))]
        tiles = each.groupBy(*[F.col(v).alias(g) for v, g in zip(of, inside, strict=True)], F.col("_millrace_t").alias("_millrace_of")).agg(F.sum("_millrace_n").alias("Tile_RecordCount"))
        tiles = tiles.withColumn("Tile_Num", F.row_number().over(Window.partitionBy(*inside).orderBy("_millrace_of")))
        each = each.join(tiles, (F.col("_millrace_t") == F.col("_millrace_of")) & prefix.same([F.col(v) for v in of], inside)).drop(*inside)
        step = df.join(each, prefix.same([names.col(c) for c in own], values))
        return self._sequenced(step.select(*[names.col(c) for c in df.columns], "Tile_Num", "Tile_RecordCount"), self.order_by)

    def _equal_sum(self, df: DataFrame, by: list[Column]) -> DataFrame:
        x = names.col(names.resolve(df, self.column))
        rules = [*self.order_by, names.quoted(names.resolve(df, self.column))]
        order = ordering.columns(rules)
        if not by and spreads(df, self.spread):
            made = prefix.running(df, rules, {"_millrace_r": x})
            if made is not None:
                return self._by_running(df, made, x, rules)
        group = Window.partitionBy(*by)
        running = F.sum(x).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        share = F.try_divide(running, F.sum(x).over(group)) * F.lit(self.n)
        step = df.withColumn("_millrace_t", F.ceil(share)).withColumn("Tile_Num", F.dense_rank().over(group.orderBy("_millrace_t")))
        return self._sequenced(step.drop("_millrace_t").withColumn("tile_sum", F.sum(x).over(Window.partitionBy(*by, "Tile_Num"))), rules)

    def _by_running(self, df: DataFrame, made: DataFrame, x: Column, rules: Sequence) -> DataFrame:
        """Tiles of equal sums from running sums; their numbers come from one row a tile."""
        made = made.crossJoin(F.broadcast(df.agg(F.sum(x).alias("_millrace_all"))))
        made = made.withColumn("_millrace_t", F.ceil(F.try_divide(F.col("_millrace_r"), F.col("_millrace_all")) * F.lit(self.n)))
        tiles = made.groupBy("_millrace_t").agg(F.sum(x).alias("tile_sum"))
        tiles = tiles.select(F.col("_millrace_t").alias("_millrace_u"), "tile_sum", F.row_number().over(Window.orderBy("_millrace_t")).alias("Tile_Num"))
        # Sums that rise and fall can pass through more than n tiles, so Spark picks the join by size.
        joined = made.join(tiles, F.col("_millrace_t").eqNullSafe(F.col("_millrace_u")))
        return self._sequenced(joined.select(*[names.col(c) for c in df.columns], "Tile_Num", "tile_sum"), rules)

    def _smart(self, df: DataFrame, by: list[Column]) -> DataFrame:
        x = names.col(names.resolve(df, self.column)).cast("double")
        statistics = [F.avg(x).alias("_millrace_m"), F.stddev_samp(x).alias("_millrace_s")]
        if not by:
            step = df.crossJoin(F.broadcast(df.agg(*statistics)))  # one row
        elif spreads(df, self.spread):
            own = [f"_millrace_g{i}" for i in range(len(by))]
            each = df.groupBy(*[c.alias(g) for c, g in zip(by, own, strict=True)]).agg(*statistics)
            step = df.join(each, prefix.same(by, own)).drop(*own)
        else:
            group = Window.partitionBy(*by)
            step = df.withColumn("_millrace_m", F.avg(x).over(group)).withColumn("_millrace_s", F.stddev_samp(x).over(group))
        # A group of one row has no deviation, and so a null tile.
        k = F.when(F.col("_millrace_s") == 0, F.lit(0)).otherwise(F.floor(F.try_divide(x - F.col("_millrace_m"), F.col("_millrace_s")) + F.lit(0.5)).cast("int"))
        step = step.withColumn("Tile_Num", k)
        if self.smart_output != "no_output_column_smartTile":
            tile = F.col("Tile_Num")
            label = F.concat(F.lit("Tile "), tile.cast("string"))
            for number, text in LABELS.items():
                label = F.when(tile == number, F.lit(text)).otherwise(label)
            if "verbose" in self.smart_output.lower():
                s = F.nullif(F.col("_millrace_s"), F.lit(0.0))
                low, high = (F.coalesce((F.col("_millrace_m") + (tile + d) * s).cast("string"), F.lit("n/a")) for d in (F.lit(-0.5), F.lit(0.5)))
                label = F.concat(label, F.lit(" ("), low, F.lit(" to "), high, F.lit(")"))
            step = step.withColumn("SmartTile_Num", label)
        return self._sequenced(step.drop("_millrace_m", "_millrace_s"), self.order_by or [names.quoted(names.resolve(df, self.column))], "TileSequence_Num")

    def _unique_value(self, df: DataFrame, by: list[Column]) -> DataFrame:
        own = names.resolve_all(df, self.columns)
        values = [names.quoted(c) for c in own]
        if not by and spreads(df, self.spread):
            keys = [f"_millrace_u{i}" for i in range(len(own))]
            each = placed(df.select(*[names.col(c).alias(k) for c, k in zip(own, keys, strict=True)]).distinct(), keys, "Tile_Num", True)
            step = df.join(each, prefix.same([names.col(c) for c in own], keys)).select(*[names.col(c) for c in df.columns], F.col("Tile_Num").cast("int").alias("Tile_Num"))
        else:
            step = df.withColumn("Tile_Num", F.dense_rank().over(Window.partitionBy(*by).orderBy(*ordering.columns(values))))
        return self._sequenced(step, self.order_by or values)

    def _manual(self, df: DataFrame, by: list[Column]) -> DataFrame:
        x = names.col(names.resolve(df, self.column)).cast("float")
        tile = F.lit(len(self.cutoffs) + 1)
        for i, cutoff in reversed(list(enumerate(self.cutoffs, 1))):
            tile = F.when(x <= F.lit(cutoff).cast("float"), F.lit(i)).otherwise(tile)
        return self._sequenced(df.withColumn("Tile_Num", tile), self.order_by or [f"cast({names.quoted(names.resolve(df, self.column))} AS float)"])
