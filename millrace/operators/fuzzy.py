"""Fuzzy matching of records with each other."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import names
from ..core.base import Operator, absent, needed

CLEANED = ("custom", "name", "address")
#: Texts with more shortened forms than this are compared with all texts about as long.
MOST_FORMS = 1024
#: Rows of one value are dealt over tasks by this many.
CHUNK = 1024


@dataclass(frozen=True)
class MatchField:
    """A column and how it is compared: custom, name, address, phone, equals, exact."""

    column: str
    function: str = "custom"


@dataclass(frozen=True)
class FuzzyMatch(Operator):
    """Pairs of records by the average similarity of their fields, in percent.

    PURGE compares all records, MERGE those of different sources; any other mode
    passes the input through.  Every pair is made once (all comparisons are
    symmetric), and fields are compared side by side, not stacked.  ``block_on`` is
    an extension: only records equal in that expression are compared.  ``exact`` scores
    mirrored strings.  A mean reaches the threshold only if one field does, so pairs
    come from joins on equal values, mirrored values and near values of each field, not
    from all pairs of records.  Near values are found once for each two distinct ones:
    texts within ``d`` edits have a form in common that leaves out up to ``d``
    characters of each.  Where record ids do not repeat, pairs are scored and filtered
    where they are made and never shuffled; rows that share an id are averaged.
    """

    record_id: str
    fields: Sequence[MatchField]
    mode: str = "PURGE"
    source_id: str | None = None
    threshold: float = 80
    with_score: bool = False
    block_on: str | None = None

    def problems(self, df: DataFrame) -> list[str]:
        out = needed(self.mode, "mode") + needed(self.record_id, "record_id") + needed(self.fields, "at least one field")
        if self.mode == "MERGE":
            out += needed(self.source_id, "source_id")
        keys = [(f.column.lower(), self._function(f)) for f in self.fields]
        if len(set(keys)) < len(keys):
            out.append("a column and function are listed twice")
        return out + absent(df, [self.record_id, self.source_id or "", *[f.column for f in self.fields]])

    @staticmethod
    def _function(f: MatchField) -> str:
        return {"phone": "EQUALS", "equals": "EQUALS", "exact": "EXACT"}.get(f.function.lower(), "LEVENSHTEIN")

    def _score(self, i: int, f: MatchField) -> Column:
        a, b = F.col(f"a.f{i}"), F.col(f"b.f{i}")
        near = (F.lit(1) - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))) * 100
        kind = self._function(f)
        if kind == "LEVENSHTEIN":
            return near
        same = (a == F.reverse(b)) & (b == F.reverse(a)) if kind == "EXACT" else a == b
        return F.when(a.isNotNull() & b.isNotNull(), F.when(same, F.lit(100.0)).otherwise(F.lit(0.0)))

    def _has_score(self, i: int, f: MatchField) -> Column:
        """Whether :meth:`_score` is not null, without its distance: a join's condition would compute that once more."""
        a, b = F.col(f"a.f{i}"), F.col(f"b.f{i}")
        both = a.isNotNull() & b.isNotNull()
        return both & (F.greatest(F.length(a), F.length(b)) > 0) if self._function(f) == "LEVENSHTEIN" else both

    @property
    def _least(self) -> float:
        """What some field's score reaches in every match: means are rounded to two digits."""
        return self.threshold - 0.006

    def _edits(self, length: int) -> int:
        return max(0, math.floor(length * (1 - self._least / 100) + 1e-9))

    def _linked(self, i: int, f: MatchField) -> Column:
        return F.coalesce(self._score(i, f) >= self._least, F.lit(False))

    def _near_values(self, rows: DataFrame, i: int, f: MatchField, tasks: int) -> DataFrame:
        """Each two different values (x < y, of one block) whose score reaches the least."""
        values = rows.filter(F.length(f"f{i}") > 0).select("block", f"f{i}").distinct()
        longest = values.agg(F.max(F.length(f"f{i}"))).first()[0] or 0
        short = 0
        while short < longest and sum(math.comb(short + 1, j) for j in range(self._edits(short + 1) + 1)) <= MOST_FORMS:
            short += 1
        v, size = F.col(f"f{i}"), F.length(f"f{i}")
        edits = F.greatest(F.lit(0), F.floor(size * F.lit(1 - self._least / 100) + F.lit(1e-9)).cast("int"))

        def shorter(t: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.length(t)), lambda at: F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + 1, F.length(t))))

        forms = F.aggregate(F.sequence(F.lit(1), edits), F.array(v), lambda found, _: F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter)))))
        cut = values.filter(size <= short).select("block", f"f{i}", F.explode(F.when(edits > 0, forms).otherwise(F.array(v))).alias("form"))
        cut = cut.select("block", f"f{i}", F.xxhash64("block", "form").alias("h")).repartition(tasks, "h")
        a, b = F.col(f"a.f{i}"), F.col(f"b.f{i}")
        found = [F.col("a.block").alias("block"), F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
        on = (F.col("a.h") == F.col("b.h")) & (F.col("a.block") == F.col("b.block")) & (a < b) & self._linked(i, f)
        near = cut.alias("a").join(cut.alias("b"), on).select(*found).distinct()
        if longest > short:
            # The longer text is reached from each length that its partner can have.
            lengths = F.explode(F.sequence(size - edits, size)).alias("size")
            long = values.filter(size > short).select("block", f"f{i}", lengths).repartition(tasks, f"f{i}", "size")
            on = (F.col("a.size") == F.col("b.size")) & (F.col("a.block") == F.col("b.block")) & ((F.length(a) > F.length(b)) | (a < b)) & self._linked(i, f)
            near = near.unionByName(long.alias("a").join(values.withColumn("size", size).alias("b"), on).select(*found))
        return near

    def _meeting(self, rows: DataFrame, i: int, f: MatchField, tasks: int) -> tuple[DataFrame, DataFrame, Column]:
        """Two sides by key, and which of their pairs differ or are in order: every pair whose field ``i`` reaches the least meets once."""
        kind, v = self._function(f), F.col(f"f{i}")
        key = F.least(v, F.reverse(v)) if kind == "EXACT" else v
        left = rows.withColumn("key", key).filter(F.length("key") > 0 if kind == "LEVENSHTEIN" else F.col("key").isNotNull())
        right, ordered = left, F.col("a.id") > F.col("b.id")
        if kind == "LEVENSHTEIN":
            near = self._near_values(rows, i, f, tasks).withColumnRenamed("block", "of")
            more = rows.join(near, (F.col("block") == F.col("of")) & (v == F.col("y"))).withColumn("key", F.col("x"))
            right = left.unionByName(more.select(*left.columns))
            ordered = F.when(F.col("a.key") == F.col(f"b.f{i}"), ordered).otherwise(F.col("a.id") != F.col("b.id"))
        hot = left.groupBy(F.col("block").alias("_b"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHUNK)
        hot = F.broadcast(hot.select("_b", "_k", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks")))
        on = (F.col("block") == F.col("_b")) & (F.col("key") == F.col("_k"))
        chunks = F.coalesce("_chunks", F.lit(1))
        left = left.join(hot, on, "left").withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        right = right.join(hot, on, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        by = ["block", "key", "chunk"] if self.block_on else ["key", "chunk"]
        # The work is in the pairs, not the rows: both sides are dealt out, however small they are.
        own = [*rows.columns, "key", "chunk"]
        return left.select(*own).repartition(tasks, *by), right.select(*own).repartition(tasks, *by), ordered

    def apply(self, df: DataFrame) -> DataFrame:
        if self.mode not in ("PURGE", "MERGE"):
            return df
        rid = names.col(names.resolve(df, self.record_id)).cast("string")
        values = []
        for i, f in enumerate(self.fields):
            v = names.col(names.resolve(df, f.column)).cast("string")
            values.append((F.upper(F.regexp_replace(v, r"\p{Punct}", "")) if f.function.lower() in CLEANED else v).alias(f"f{i}"))
        source = names.col(names.resolve(df, self.source_id)).cast("string") if self.source_id else F.lit("")
        block = F.expr(self.block_on).cast("string") if self.block_on else F.lit("")
        rows = df.select(rid.alias("id"), source.alias("src"), block.alias("block"), *values)
        allowed = F.lit(True)
        if self.mode == "MERGE":
            allowed = allowed & (F.col("a.src") != F.col("b.src"))
        if self.block_on:
            allowed = allowed & (F.col("a.block") == F.col("b.block"))
        scores = [self._score(i, f) for i, f in enumerate(self.fields)]
        total = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0)).alias("t")
        count = sum((self._has_score(i, f).cast("int") for i, f in enumerate(self.fields)), F.lit(0)).alias("n")
        ids = [F.greatest("a.id", "b.id").alias("record_id1"), F.least("a.id", "b.id").alias("record_id2")]
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty()
        if self._least <= 0:
            # Pairs with nothing in common match too.
            dealt = rows.repartition(tasks, "block", "id") if self.block_on else rows.repartition(tasks, "id")
            pairs = dealt.alias("a").join(rows.alias("b"), allowed & (F.col("a.id") > F.col("b.id"))).select(*ids, total, count)
        else:
            pairs = None
            for i, f in enumerate(self.fields):
                left, right, ordered = self._meeting(rows, i, f, tasks)
                on = (F.col("a.key") == F.col("b.key")) & (F.col("a.chunk") == F.col("b.chunk")) & ordered & allowed
                if self._function(f) == "EXACT":
                    on = on & (F.col(f"a.f{i}") == F.reverse(F.col(f"b.f{i}")))
                for j in range(i):
                    on = on & ~self._linked(j, self.fields[j])  # made by that field
                met = left.alias("a").join(right.alias("b"), on).select(*ids, total, count)
                pairs = met if pairs is None else pairs.unionByName(met)
            if not once:
                # A mean of several rows needs all of them, near or not.
                near = pairs.select("record_id1", "record_id2").distinct()
                both = rows.alias("a").join(near, F.col("a.id") == F.col("record_id1")).join(rows.alias("b"), (F.col("b.id") == F.col("record_id2")) & allowed)
                pairs = both.select("record_id1", "record_id2", total, count)
        if once:
            # Each pair is one row: scored and dropped where it is made, so only matches go further.
            own = pairs.select("record_id1", "record_id2", F.round(F.try_divide("t", "n"), 2).alias("similarity_score")).filter(F.col("similarity_score") >= self.threshold)
            return own if self.with_score else own.drop("similarity_score")
        out = pairs.groupBy("record_id1", "record_id2").agg(F.round(F.try_divide(F.sum("t"), F.sum("n")), 2).alias("similarity_score")).filter(F.col("similarity_score") >= self.threshold)
        return out if self.with_score else out.drop("similarity_score")
