"""Relations by name: tables of the catalog, or Parquet under a folder."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; filters and column choices reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def relation(spark: SparkSession, names: str | Sequence[str]) -> DataFrame:
    """A table, view or list of them; a list is the product of its members.

    The product is what a comma-separated FROM means; give one name unless that is
    wanted, as it grows with the product of the row counts.
    """
    every = [names] if isinstance(names, str) else list(names)
    if not every:
        return spark.range(1).select()
    return reduce(DataFrame.crossJoin, [spark.table(n) for n in every])


def save(df: DataFrame, table: str, mode: str = "overwrite", partition_by: Sequence[str] = (), format: str = "parquet") -> None:
    """Writes ``df`` as a table of the catalog."""
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
