"""All operators by name."""

from .aggregate import CountRecords, WeightedAverage
from .columns import DynamicSelect, MultiColumnEdit, MultiColumnRename, Transpose, UnionByName
from .fuzzy import FuzzyMatch, MatchField
from .generate import GenerateRows
from .impute import Imputation
from .parse import JSONParse, Regex, RegexGroup, TextToColumns, XMLParse
from .rows import FindDuplicates, RecordID, RunningTotal, Sample
from .tables import TableOperations
from .text import DataCleansing, DataEncoderDecoder, DataMasking
from .tile import Tile
from .todo import AssertExpression, ToDo

__all__ = [
    "AssertExpression", "CountRecords", "DataCleansing", "DataEncoderDecoder", "DataMasking", "DynamicSelect", "FindDuplicates", "FuzzyMatch",
    "GenerateRows", "Imputation", "JSONParse", "MatchField", "MultiColumnEdit", "MultiColumnRename", "RecordID", "Regex", "RegexGroup",
    "RunningTotal", "Sample", "TableOperations", "TextToColumns", "Tile", "ToDo", "Transpose", "UnionByName", "WeightedAverage", "XMLParse",
]
