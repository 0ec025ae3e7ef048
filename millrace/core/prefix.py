"""Row numbers and running sums over a whole table without one task for all rows.

Rows fall into bins by the first order key: bounds are its quantiles, of a sample where
the key is no number or time, so bins hold about as many rows each and follow one
another in the order.  Without an order, bins are the partitions as they come.  Numbers and sums are
made within bins, and what the bins before hold is added: one row a bin, at most
``MOST + 2`` of them, so that side is broadcast.

The bounds are at most ``MOST`` values, from at most some ``MOST * PER_BOUND`` sampled ones, fetched when the plan is made.
Rows of equal first key share a bin; one value that fills the table fills a bin.

Within groups the same is done for hot groups only: those of more than ``HOT_ROWS`` rows and
more than one ``HOT_GROUPS``-th of the table, so there are fewer than ``HOT_GROUPS`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import names, ordering

MOST = 1024
#: Tables that Spark estimates below this are numbered by one task, which is quicker for them.  The estimate is of
#: compressed columns, one or two bytes for a key of a file in its order, and a task sorts some hundred bytes for each.
LARGE = 8 << 20
BIN = "_millrace_bin"
PER_BOUND = 20
HOT_ROWS, HOT_GROUPS = 1 << 20, 10_000


def is_large(df: DataFrame) -> bool:
    """Whether the optimiser's estimate of the table's size is ``LARGE`` or more."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LARGE


def _number(df: DataFrame, key: Column) -> Column | None:
    """The key as a double that rises with it, or None if its type has none."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, T.NumericType):
        return key.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        days = F.unix_date(key.cast("date")).cast("double") * F.lit(86400.0)
        if isinstance(kind, T.DateType):
            return days
        return days + F.hour(key) * F.lit(3600) + F.minute(key) * F.lit(60) + F.extract(F.lit("SECOND"), key).cast("double")
    return None


def _sampled(df: DataFrame, key: Column, parts: int) -> list:
    """Bounds of about equal parts for a key of any type that sorts."""
    keys = df.select(key.alias("k")).filter("k IS NOT NULL")
    n = keys.count()
    if not n:
        return []
    found = sorted(r["k"] for r in keys.sample(min(1.0, PER_BOUND * parts / n), seed=1).collect())
    return [found[i * len(found) // parts] for i in range(1, parts)] if found else []


def by_partition(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``sums`` as its sum up to the row, in the order in which rows come.

    ``df`` is read twice; should its partitions differ between the two, it raises.
    """
    part, place = "_millrace_part", "_millrace_place"
    # The id has the partition in its upper bits and the place in its lower 33.
    step = df.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33))
    each = step.groupBy(part).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col(part).alias("_millrace_p"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    within = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = step.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(each, F.col(part) == F.col("_millrace_p"), "left")
    found = F.when(F.col("_millrace_p").isNull(), F.raise_error(F.lit("partitions changed between two reads"))).otherwise(F.lit(0))
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") + found for n in sums}).drop(part, place, "_millrace_p", *[f"_before_{n}" for n in sums])


def _below(edges: list, x: Column) -> Column:
    """How many of the rising ``edges`` are below ``x``, by halving; the key, which may be dear, is computed once a row.

    It is never null and says so: a join on it would else first ask whether it is, and place each row once more for that.
    """
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    bounds = F.array(*[F.lit(b) for b in edges])

    def found(v: Column) -> Column:
        return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.try_element_at(bounds, at + half) < v, at + half).otherwise(at))

    return F.coalesce(F.element_at(F.transform(F.array(x), found), 1), F.lit(0))


def bins(df: DataFrame, order: Sequence) -> Column | None:
    """An integer that rises with the order, bounds being those of ``df``; None if there is no order, or its first key is nested."""
    rules = ordering.rules(order)
    if not rules:
        return None
    key = F.expr(rules[0].expression)
    x = _number(df, key)
    parts = min(MOST, max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if x is None:
        if not isinstance(df.select(key.alias("k")).schema["k"].dataType, (T.StringType, T.BinaryType, T.BooleanType)):
            return None
        x, bounds = key, _sampled(df, key, parts)
    else:
        bounds = df.select(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first()["b"] or []
    edges = sorted({b for b in bounds if b == b})
    place = _below(edges, x) if edges else F.lit(0)
    rises, nulls_first = rules[0].sort.startswith("asc"), rules[0].sort in ("asc", "desc_nulls_first")
    null = F.lit(-MOST - 1 if nulls_first else MOST + 1)
    return F.when(x.isNull(), null).otherwise(place if rises else -place).cast("int")


def running(df: DataFrame, order: Sequence, sums: dict[str, Column]) -> DataFrame | None:
    """``df`` with each of ``sums`` (name to what is added up) as its sum up to the row in ``order``.

    A row number is the sum of ones.  None if the order's first key has no bins.
    """
    place = bins(df, order)
    if place is None:
        return None
    rows = df.withColumn(BIN, place)
    before = Window.orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(BIN).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    each = each.select(F.col(BIN).alias("_millrace_b"), *[F.sum(f"_s_{n}").over(before).alias(f"_before_{n}") for n in sums])
    within = Window.partitionBy(BIN).orderBy(*ordering.columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    joined = local.join(F.broadcast(each), F.col(BIN) == F.col("_millrace_b"))
    # As for one window, a sum is null only where nothing has been added yet.
    total = {n: F.coalesce(F.col(n) + F.col(f"_before_{n}"), F.col(n), F.col(f"_before_{n}")) for n in sums}
    return joined.withColumns(total).drop(BIN, "_millrace_b", *[f"_before_{n}" for n in sums])


def same(left: Sequence[Column], right: Sequence[str]) -> Column:
    """Whether columns are equal pair by pair, null to null."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & a.eqNullSafe(F.col(b))
    return on


def within(df: DataFrame, groups: Sequence[str], order: Sequence, sums: dict[str, Column]) -> DataFrame | None:
    """As ``running``, from the first row of each group of equal ``groups``.

    None if no group is hot or the order's first key has no bins: one window does
    then.  Groups are counted first, which combines map-side.  Rows of other groups
    share a bin of their own and are windowed as ever.
    """
    keys = [names.col(c) for c in groups]
    own = [f"_millrace_g{i}" for i in range(len(keys))]
    least = max(HOT_ROWS, df.count() // HOT_GROUPS)
    counts = df.groupBy(*[c.alias(g) for c, g in zip(keys, own, strict=True)]).agg(F.count(F.lit(1)).alias("_millrace_n"))
    hot = counts.filter(F.col("_millrace_n") > least).select(*own, F.lit(True).alias("_millrace_hot"))
    if hot.isEmpty():
        return None
    # No hint on either join: keys may be long, so Spark goes by their sizes.
    marked = df.join(hot, same(keys, own), "left").drop(*own)
    place = bins(marked.filter("_millrace_hot"), order)
    if place is None:
        return None
    rows = marked.withColumn(BIN, F.when(F.col("_millrace_hot"), place).otherwise(-MOST - 2))
    each = rows.filter("_millrace_hot").groupBy(*[c.alias(g) for c, g in zip(keys, own, strict=True)], F.col(BIN).alias("_millrace_b"))
    before = Window.partitionBy(*own).orderBy("_millrace_b").rowsBetween(Window.unboundedPreceding, -1)
    each = each.agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]).select(*own, "_millrace_b", *[F.sum(f"_s_{n}").over(before).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*keys, BIN).orderBy(*ordering.columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    joined = local.join(each, same(keys, own) & (F.col(BIN) == F.col("_millrace_b")), "left")
    total = {n: F.coalesce(F.col(n) + F.col(f"_before_{n}"), F.col(n), F.col(f"_before_{n}")) for n in sums}
    return joined.withColumns(total).drop(BIN, "_millrace_hot", "_millrace_b", *own, *[f"_before_{n}" for n in sums])
