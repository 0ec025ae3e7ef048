"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``.  So when a stage
starts, what the one before it kept in the shared folder is done with and deleted.
What the last stage keeps stays as long as the session, as its result is still read; and
each thread has its own notes, so runs do not delete each other's tables.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import mixing, near_dup, packing, pii, quality_rules, scratch, words

_done_with: ContextVar[tuple[str, ...]] = ContextVar("done_with", default=())


def _stage(function):
    """Deletes what the stage before left, and notes what this one makes."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _done_with.get():
            scratch.drop(spark, path)
        with scratch.owned() as paths:
            out = function(spark, docs, sf_dir)
        _done_with.set(() if function is STAGES[-1][1].__wrapped__ else tuple(paths))
        return out

    return wraps(function)(run_stage)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("row")), keep=["row"])
    return judged.filter("kept").select("row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, 0.8 or more.

    Rows that repeat an id are one document.  A row without an id goes by a number
    above all usual ids, made of its text, so that those with an id stay before it;
    rows with neither id nor words all stay.
    """
    made = F.when(F.col("text").rlike(words.WORD), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), made))
    kept = near_dup.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), size=5, percent=80).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    named = rows.join(kept, "_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("text"))).filter("_n = 1")
    return named.select(docs.columns).union(rows.filter("_id IS NULL").select(docs.columns))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data put as its kind in brackets."""
    return pii.redacted(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")), keep=["row"])
    copies = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return taken.filter("taken > 0").select("row", F.explode(copies)).select("row.*")


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces, packed into sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("source mixing", mix), ("packing", pack)]

#: Tokens, sketches and the automaton are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = scratch.table(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
