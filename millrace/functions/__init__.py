"""Operators as functions for ``DataFrame.transform``: ``df.transform(running_total(["x"]))``."""

from __future__ import annotations

from ..operators import (
    AssertExpression as assert_expression,
    CountRecords as count_records,
    DataCleansing as data_cleansing,
    DataEncoderDecoder as data_encoder_decoder,
    DataMasking as data_masking,
    DynamicSelect as dynamic_select,
    FindDuplicates as find_duplicates,
    FuzzyMatch as fuzzy_match,
    GenerateRows as generate_rows,
    Imputation as imputation,
    JSONParse as json_parse,
    MultiColumnEdit as multi_column_edit,
    MultiColumnRename as multi_column_rename,
    RecordID as record_id,
    Regex as regex,
    RunningTotal as running_total,
    Sample as sample,
    TableOperations as table_operations,
    TextToColumns as text_to_columns,
    Tile as tile,
    ToDo as to_do,
    Transpose as transpose,
    UnionByName as union_by_name,
    WeightedAverage as weighted_average,
    XMLParse as xml_parse,
)

__all__ = [
    "assert_expression", "count_records", "data_cleansing", "data_encoder_decoder", "data_masking", "dynamic_select", "find_duplicates", "fuzzy_match",
    "generate_rows", "imputation", "json_parse", "multi_column_edit", "multi_column_rename", "record_id", "regex", "running_total", "sample",
    "table_operations", "text_to_columns", "tile", "to_do", "transpose", "union_by_name", "weighted_average", "xml_parse",
]
