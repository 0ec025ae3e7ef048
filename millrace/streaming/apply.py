"""Operators that look at one row at a time run on streams as they are; the others run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..core.errors import UnsupportedOperation
from ..operators import (
    AssertExpression,
    DataCleansing,
    DataEncoderDecoder,
    DataMasking,
    DynamicSelect,
    GenerateRows,
    JSONParse,
    MultiColumnEdit,
    MultiColumnRename,
    RecordID,
    Regex,
    TextToColumns,
    Transpose,
    XMLParse,
)

ROW_WISE = (AssertExpression, DataCleansing, DataEncoderDecoder, DataMasking, DynamicSelect, GenerateRows, JSONParse, MultiColumnEdit, MultiColumnRename, Regex, TextToColumns, Transpose, XMLParse)


def row_wise(operator: object) -> bool:
    """Whether an operator's result for a row depends on that row alone."""
    return isinstance(operator, ROW_WISE) or (isinstance(operator, RecordID) and operator.method == "uuid")


def on_stream(stream: DataFrame, *operators: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stream`` through row-wise operators, without state."""
    for operator in operators:
        if not row_wise(operator):
            raise UnsupportedOperation(f"{type(operator).__name__} needs all rows of a table; use by_batch")
        stream = operator(stream)
    return stream


def by_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], *operators: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that puts each micro-batch through ``operators`` and hands it to ``sink``.

    Numbers, ranks and statistics then are those of the batch.  ``sink`` gets the
    batch's id, by which it can skip one that it already has.
    """

    def run(batch: DataFrame, number: int) -> None:
        for operator in operators:
            batch = operator(batch)
        sink(batch, number)

    return stream.writeStream.foreachBatch(run)
