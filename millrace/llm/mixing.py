"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / quality``, with ``u`` drawn from its id, its
text and the seed; the smallest keys come first.  A source whose target is ``e`` times
its size and a rest is taken ``e`` times whole (complete epochs), and the rest is
selected by key: a prefix sum of sizes against the budget.

The prefix sum never sorts a whole source in one task.  Keys fall into bins of
about equal probability; sizes are summed by (source, bin) with map-side
combining, a running sum over the bins finds the one bin where the budget ends,
and only that bin's keys are put in order, copies of a key counted before.  What comes
out of it is one row a source: the key at which the budget ends, and how many of the
rows that share it are taken.  Rows share a key only if they repeat id and text, so
which of them are taken makes no difference; they are counted partition by partition.

Defined results: null text counts as size 0; a null source is a source of its
own, last in order; a null ``doc_id`` is an id like any other, shared by all rows
without one; of rows that repeat id, source and text, some can be taken and others left;
an empty table gives an empty table; other columns pass through, and clashing names
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .words import SPACES, count_words

WEIGHTS = (5.0, 2.0, 1.0)
EPOCH_LIMIT = 3
BINS = 1 << 12
SEED = 20240229


def quality_weight(text: Column, size: Column) -> Column:
    """A weight in [0.25, 1.25] from three signs of running text.

    The share of letters (ASCII letters and all beyond ASCII) among characters that are
    no white space; words of usual length, three to nine characters; and enough words,
    ``size / (size + 20)``.  Their product, and a quarter.  Empty and null texts: 0.25.
    """
    own = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(own, r"[\x00-@\[-`{-\x7F]+", ""))
    solid = F.length(F.regexp_replace(own, SPACES, ""))
    per_word = solid / F.greatest(size, F.lit(1))
    off = F.greatest(F.lit(3.0) - per_word, per_word - F.lit(9.0), F.lit(0.0))
    return F.lit(0.25) + (letters / F.greatest(solid, F.lit(1))) * F.exp(-off / F.lit(3.0)) * (size / (size + F.lit(20.0)))


def uniform(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) made of the id, the text and the seed alone: 52 bits of an MD5."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = EPOCH_LIMIT) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes.  No target is above ``limit`` times its source's size;
    what is cut off goes to the others by weight until none is above.  That level
    is found at once: in order of limit per weight, the first source whose share
    of what is left stays under its limit has the level of all after it.

    The windows here run over one row a source.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_turn") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = by_source.withColumn("_turn", F.row_number().over(turn)).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_turn").asc())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("_held", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_w_left", F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("_held")) / F.col("_w_left"))
        .withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_turn").alias("t"), F.col("_level").alias("level")))).over(everything))
    )
    target = F.when(F.col("_first").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_first")["level"] * F.col("_w")))
    return t.select("source", "source_size", F.round(target, 6).alias("target"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size`` and ``_key``."""
    # The weight is read off the size by name: one count of words a text.
    return docs.withColumn("size", count_words(F.col("text"))).withColumn("_key", -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality_weight(F.col("text"), F.col("size")))


def plan_sources(rows: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = EPOCH_LIMIT, bins: int = BINS) -> DataFrame:
    """One row a source: ``source, source_size, target, epochs, _cut, _some, _copies``.

    ``rows`` has ``source, size, _key``.  Documents of smaller keys than ``_cut`` are
    taken once more than ``epochs`` times, and so are ``_some`` of the ``_copies`` rows
    whose key it is.  ``_cut`` is null where there is no budget left to select for.
    """
    # exp(-key) is near uniform, so bins hold about as many documents each.
    binned = rows.withColumn("_bin", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.lit(bins)))
    sums = binned.groupBy("source", "_bin").agg(F.sum("size").alias("_sum"))
    by_source = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, limit)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    by_source = by_source.withColumn("epochs", epochs.cast("long")).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    by_source = scratch.table(by_source, "mix-targets")
    in_order = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(in_order), F.lit(0)))
    named = by_source.select(F.col("source").alias("_s"), "_rest")
    ends = (
        sums.join(named, F.col("source").eqNullSafe(F.col("_s")))
        .filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum")))
        .select(F.col("source").alias("_s"), F.col("_bin").alias("_end"), "_before", "_rest")
    )
    ends = scratch.table(ends, "mix-ends")
    # Rows of one key are counted before the sort: combined map-side, one row a key.
    at_end = binned.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_end"))).groupBy("source", "_key", "size", "_before", "_rest").agg(F.count(F.lit(1)).alias("_copies"))
    upto = F.col("_before") + F.sum(F.col("size") * F.col("_copies")).over(Window.partitionBy("source").orderBy("_key", "size"))
    # A copy on which the budget ends goes in if the sum is then nearer to it.
    room = F.col("_rest") - (F.col("_upto") - F.col("size") * F.col("_copies"))
    at_end = (
        at_end.withColumn("_upto", upto)
        .filter(F.col("_upto") > F.col("_rest"))
        .withColumn("_some", F.ceil(room / F.col("size") - F.lit(0.5)).cast("long"))
        .groupBy("source")
        .agg(F.min(F.struct("_key", "size", "_some", "_copies")).alias("_c"))
        .select(F.col("source").alias("_s"), F.col("_c")["_key"].alias("_cut"), F.col("_c")["_some"].alias("_some"), F.col("_c")["_copies"].alias("_copies"))
    )
    return by_source.join(at_end, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "epochs", "_cut", "_some", "_copies")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_nth``, from 1 within each source: places within partitions, after the rows of the partitions before."""
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    local = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_place")))
    joined = local.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_nth", F.col("_nth") + F.col("_first")).drop("_part", "_place", "_s", "_p", "_first")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = EPOCH_LIMIT, seed: int = SEED, bins: int = BINS, keep: Sequence[str] = ()) -> DataFrame:
    """Each row of ``docs`` with ``size, source_size, target, taken``.

    ``keep`` names further columns of ``docs`` to return.
    """
    rows = scratch.table(sized(docs, seed).select("doc_id", "source", "size", "_key"), "mix-sizes")
    plan = scratch.table(plan_sources(rows, weights, limit, bins).withColumnRenamed("source", "_source"), "mix-plan")
    rows = sized(docs, seed) if keep else rows
    # The plan is a written table: Spark knows its size and broadcasts it only under its threshold.
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    at_cut = F.coalesce(F.col("_key") == F.col("_cut"), F.lit(False))
    extra = F.coalesce(F.col("_key") < F.col("_cut"), F.lit(False)) | (at_cut & (F.col("_some") >= F.col("_copies")))

    def out(rows: DataFrame, extra: Column) -> DataFrame:
        taken = F.col("size") * (F.col("epochs") + extra.cast("long"))
        return rows.select("doc_id", *keep, "size", "source_size", "target", taken.alias("taken"))

    # Only a key of several rows that is taken in part needs its rows numbered.
    parted = (F.col("_some") > 0) & (F.col("_some") < F.col("_copies"))
    if plan.filter(parted).isEmpty():
        return out(rows, extra)
    some = at_cut & parted
    numbered = _numbered(scratch.table(rows.filter(some), "mix-some"))  # written, so that its partitions stay as they are
    return out(rows.filter(~F.coalesce(some, F.lit(False))), extra).union(out(numbered, F.col("_nth") <= F.col("_some")))
