"""Words as every operator of this subpackage counts them: runs of anything but
the space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def split_words(text: Column) -> Column:
    """The words of ``text`` in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def count_words(text: Column) -> Column:
    """How many words ``text`` has, as a long; 0 for null."""
    return F.size(split_words(text)).cast("long")
