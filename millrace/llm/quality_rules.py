"""Quality rules: divergence of a text's histograms from those of its language.

For each language the corpus gives two reference histograms, gathered over all
its documents: shares of character classes, and shares of the language's most
common words with one bin for every other word.  A document's own histograms are
compared with them by Jensen-Shannon distance (base 2, so from 0 to 1).  Texts
with too few characters or words for a fair histogram are not judged by them.

Nor are texts of a language whose whole corpus is below ``min_reference`` words: its
histograms would be little more than the texts' own.

Everything is DataFrame expressions.  Counting words explodes (language, word)
pairs, which combine map-side before the shuffle.  The references are written tables
of one row a language, joined by language: Spark knows their size and broadcasts them
only under its threshold, however many languages there are.

Defined results: null text counts as empty; null language is a language of its
own; repeated rows are judged one by one; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .words import split_words

COMMON = 16
MIN_CHARS = 200
MIN_WORDS = 50
MIN_REFERENCE = 1000
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.55
WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "beyond", "other")
PLAIN = "abcdefghijklmnopqrstuvwxyz "
NO_LANG = "\x00null"


class Rules(NamedTuple):
    """Thresholds; the defaults are the production values."""

    common: int = COMMON
    min_chars: int = MIN_CHARS
    min_words: int = MIN_WORDS
    min_reference: int = MIN_REFERENCE
    max_class_distance: float = MAX_CLASS_DISTANCE
    max_word_distance: float = MAX_WORD_DISTANCE
    min_words_base: int = 20
    max_repeat_percent: int = 30


def _left(text: Column, drop: str) -> Column:
    """Characters of ``text`` that stay when ``drop`` is deleted."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def class_counts(text: Column) -> dict[str, Column]:
    """Characters of each class but ``space`` and ``lower``, from ``text`` without ``PLAIN``.

    Each is one pass that deletes long runs.  Small letters and spaces, most of a text,
    are of no class here; taken out once before, they spare these passes most of their work.
    """
    return {
        "upper": _left(text, "[^A-Z]+"),
        "digit": _left(text, "[^0-9]+"),
        "symbol": _left(text, SYMBOLS),
        "beyond": _left(text, r"[\x00-\x7F]+"),
        "other": _left(text, r"[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>\x80-\x{10FFFF}]+"),
    }


def _half_hashes(words: Column) -> Column:
    """A hash for each window of half of ``WINDOW`` words, from those of its pairs; the last few are of shorter ones."""
    shifted = lambda h, by: F.slice(h, F.lit(1 + by), F.greatest(F.size(h) - by, F.lit(0)))
    once = lambda column, made: F.element_at(F.transform(F.array(column), made), 1)
    pairs = once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.zip_with(h, shifted(h, 1), lambda a, b: F.xxhash64(a, b)))
    return once(pairs, lambda h: F.zip_with(h, shifted(h, 2), lambda a, b: F.xxhash64(a, b)))


def repeated_words(halves: Column, n_words: Column, size: int = WINDOW) -> Column:
    """Words covered by those windows of ``size`` words that occur twice or more.

    ``halves`` are hashes of the windows of half that length.  Where none of them
    occurs twice, no window does, and that is nearly every text.  Otherwise whole
    windows are made of two halves each and sorted by hash, which puts equal ones
    side by side; their places, in order, are joined into the length they cover.
    Linear but for the sort.
    """
    half = size // 2
    n_halves, n = F.greatest(n_words - (half - 1), F.lit(0)), F.greatest(n_words - (size - 1), F.lit(0))
    whole = F.zip_with(F.slice(halves, F.lit(1), n), F.slice(halves, F.lit(1 + half), n), lambda a, b: F.xxhash64(a, b))
    by_hash = F.sort_array(F.transform(whole, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # One-element arrays name a value once that is used twice.
    beside = F.transform(F.array(by_hash), lambda s: F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(F.element_at(beside, 1), lambda x: x.isNotNull()))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + size - F.greatest(acc["end"] - p, F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    own = F.slice(halves, F.lit(1), n_halves)
    return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(covered)


def lang_key(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(NO_LANG))


def common_words(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """One row a language: ``_l``, its most common words ``_mine``, their shares ``_q`` and all its words ``_total``.

    Over all documents; ranked by count, ties to the smaller word.
    """
    words = split_words(F.col("text"))
    every = docs.select(lang_key(F.col("lang")).alias("_l"), F.explode(words).alias("word")).groupBy("_l", "word").agg(F.count(F.lit(1)).alias("n"))
    every = scratch.table(every, "quality-words")
    totals = every.groupBy("_l").agg(F.sum("n").alias("_total"))
    # Spark cuts each task's share to its first ``common`` before the shuffle.
    first = Window.partitionBy("_l").orderBy(F.desc("n"), F.asc("word"))
    top = every.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= common).groupBy("_l").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("_top"))
    shares = F.transform("_top", lambda x: x["n"] / F.col("_total"))
    out = top.join(totals, "_l").select("_l", F.col("_top.word").alias("_mine"), shares.alias("_q"), "_total")
    return scratch.table(out, "quality-common")


def features(docs: DataFrame, common: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``_lang``, the word reference and the counts of each text."""
    lines = F.split(F.col("_t"), "\n")
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = F.when(F.size(lines) == F.size(F.array_distinct(lines)), F.lit(0)).otherwise(F.size(worded) - F.size(F.array_distinct(worded)))
    step = docs.select("doc_id", *keep, lang_key(F.col("lang")).alias("_lang"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    step = step.join(common, F.col("_lang") == F.col("_l"), "left").drop("_l")
    step = step.withColumns({"_mine": F.coalesce("_mine", F.array().cast("array<string>")), "_q": F.coalesce("_q", F.array().cast("array<double>")), "_total": F.coalesce("_total", F.lit(0))})
    kept = ["doc_id", *keep, "_lang", "_q", "_total", "_mine"]
    step = step.select(
        *kept,
        split_words(F.col("_t")).alias("_w"),
        F.length("_t").cast("long").alias("n_chars_text"),
        dup_lines.cast("long").alias("n_dup_lines"),
        F.translate("_t", PLAIN, "").alias("_rest"),
    )
    kept += ["n_chars_text", "n_dup_lines"]
    step = step.select(
        *kept,
        *[c.alias(f"_c_{k}") for k, c in class_counts(F.col("_rest")).items()],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _half_hashes(F.col("_w")).alias("_h"),
        F.concat(F.lit(" "), F.array_join(F.filter("_w", lambda w: F.array_contains("_mine", w)), "  "), F.lit(" ")).alias("_hits"),
    )
    kept += [f"_c_{k}" for k in CLASSES if k not in ("lower", "space")] + ["n_words", "word_chars"]
    one = lambda c: ((F.length("_hits") - F.length(F.replace(F.col("_hits"), F.concat(F.lit(" "), c, F.lit(" ")), F.lit("")))) / (F.length(c) + 2)).cast("long")
    step = step.select(
        *[c for c in kept if c != "_mine"],
        repeated_words(F.col("_h"), F.col("n_words").cast("int")).cast("long").alias("n_repeat_words"),
        F.transform("_mine", one).alias("_common"),
        (F.col("n_chars_text") - F.col("word_chars")).alias("_c_space"),
    )
    lower = F.col("n_chars_text")
    for k in CLASSES:
        if k != "lower":
            lower = lower - F.col(f"_c_{k}")
    return step.withColumn("_c_lower", lower)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of equal length."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def class_shares(rows: DataFrame) -> DataFrame:
    """One row a language: ``_l`` and ``_class_q``, its shares of character classes over all its documents."""
    names = [f"_c_{k}" for k in CLASSES]
    sums = rows.groupBy(F.col("_lang").alias("_l")).agg(*[F.sum(c).alias(c) for c in names])
    total = F.greatest(sum((F.col(c) for c in names), F.lit(0)), F.lit(1))
    return scratch.table(sums.select("_l", F.array(*[F.col(c) / total for c in names]).alias("_class_q")), "quality-classes")


def judge(docs: DataFrame, rules: Rules = Rules(), keep: Sequence[str] = ()) -> DataFrame:
    """Each row of ``docs``: ``doc_id``, the columns in ``keep``, counts and verdict.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` are counts;
    ``base_failed`` holds for texts of under ``min_words_base`` words or with more
    than ``max_repeat_percent`` of them in repeated windows; ``class_distance``
    and ``word_distance`` are null under the guards on length and reference; ``kept`` is false
    where ``base_failed`` or a distance is above its limit.
    """
    with scratch.only(docs.sparkSession, "quality-features"):
        rows = scratch.table(features(docs, common_words(docs, rules.common), keep), "quality-features")
    out = rows.join(class_shares(rows), F.col("_lang") == F.col("_l"))
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars_text"), F.lit(1))
    add = lambda xs, zero: F.aggregate(xs, zero, lambda acc, x: acc + x)
    own_words = F.concat(F.transform("_common", lambda c: c / n), F.array((F.col("n_words") - add(F.col("_common"), F.lit(0).cast("long"))) / n))
    word_ref = F.concat("_q", F.array(F.greatest(F.lit(0.0), F.lit(1.0) - add(F.col("_q"), F.lit(0.0)))))
    own_classes = F.array(*[F.col(f"_c_{k}") / chars for k in CLASSES])
    known = F.col("_total") >= rules.min_reference
    out = out.withColumn("class_distance", F.when(known & (F.col("n_chars_text") >= rules.min_chars), F.round(distance(own_classes, F.col("_class_q")), 5)))
    out = out.withColumn("word_distance", F.when(known & (F.col("n_words") >= rules.min_words), F.round(distance(own_words, word_ref), 5)))
    failed = (F.col("n_words") < rules.min_words_base) | (F.lit(100) * F.col("n_repeat_words") > F.lit(rules.max_repeat_percent) * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance)
    return out.select("doc_id", *keep, "n_words", "word_chars", F.col("_c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "word_distance")
