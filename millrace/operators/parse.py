"""Parsing of text columns: patterns, delimiters, JSON and XML."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import names
from ..core.base import Operator, absent, needed


def has_group(pattern: str) -> bool:
    """Whether a pattern has a capturing group."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    return bool(re.search(r"\((?!\?)|\(\?<(?![=!])|\(\?P<", plain))


@dataclass(frozen=True)
class RegexGroup:
    """An output column for a capturing group, and its type."""

    name: str
    type: str = "string"


_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:P?<(?![=!])(\w+)>)?)?|\)", re.S)
_NUMBER = re.compile(r"(?:\\d|\[0-9\])(?:[+*?]|\{\d+(?:,\d*)?\})?")


def detected_groups(pattern: str, root: str = "regex_col") -> list[RegexGroup]:
    """The capturing groups of a pattern in order of their opening: by their own names, else ``<root><number>``."""
    found: list[list] = []
    opened: list[list | None] = []
    for m in _PARTS.finditer(pattern):
        if m[0] == "(" or m[1]:
            found.append([m[1] or f"{root}{len(found) + 1}", m.end(), len(pattern)])
            opened.append(found[-1])
        elif m[0].startswith("("):
            opened.append(None)
        elif m[0] == ")" and opened and (group := opened.pop()):
            group[2] = m.start()
    return [RegexGroup(name, guessed_type(pattern[a:b])) for name, a, b in found]


def guessed_type(body: str) -> str:
    """The type of what a group's pattern can match: int, double, date or boolean where it is plain, else string."""
    if sorted(body.lower().split("|")) in (["false", "true"], ["no", "yes"], ["n", "y"]):
        return "boolean"
    # Each run of digits as one mark; what is left between them tells the rest.
    shape = _NUMBER.sub("9", body).replace("\\-", "-").removeprefix("-?").removeprefix("[+-]?")
    if re.fullmatch("9+", shape):
        return "int"
    if re.fullmatch(r"9+(?:\\\.|\[\.\])9+|9+\(\?:(?:\\\.|\[\.\])9+\)\?", shape):
        return "double"
    return "date" if re.fullmatch(r"(?:\\d|\[0-9\])\{4\}-(?:\\d|\[0-9\])\{2\}-(?:\\d|\[0-9\])\{2\}", body) else "string"


@dataclass(frozen=True)
class Regex(Operator):
    """Replaces, parses, tokenizes or matches by a pattern.

    replace: all columns and ``<column><suffix>``.  parse: a column a group,
    '' as null, cast where possible; without ``groups`` those of the pattern, their
    types guessed.  tokenize: matches (group 1 if the pattern
    has one) to ``<root>1..n`` (splitColumns), to rows with ``token_position``
    (splitRows), or the groups of the first match (any other ``tokenize_output``).
    ``extra`` with more matches than columns: dropExtraWithoutWarning,
    dropExtraWithError (each column says so) or saveAllRemainingText.  match: 1
    or 0; ``only_matches`` keeps only matching rows.
    """

    column: str
    pattern: str
    output: str = "replace"
    groups: Sequence[RegexGroup] = ()
    ignore_case: bool = True
    allow_blank: bool = False
    replacement: str = ""
    copy_unmatched: bool = False
    tokenize_output: str = "splitColumns"
    n: int = 3
    extra: str = "dropExtraWithoutWarning"
    root: str = "regex_col"
    match_column: str = "regex_match"
    only_matches: bool = False
    suffix: str = "_replaced"

    def problems(self, df: DataFrame) -> list[str]:
        out = needed(self.column, "column") + needed(self.pattern, "pattern") + absent(df, [self.column])
        if self.output not in ("replace", "parse", "tokenize", "match"):
            out.append(f"unknown output {self.output!r}")
        if self.output == "parse":
            out += needed(self.groups or has_group(self.pattern or ""), "at least one group")
        if self.output == "tokenize" and self.n < 1:
            out.append("n must be at least 1")
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        name = names.resolve(df, self.column)
        c = names.col(name)
        p = ("(?i)" if self.ignore_case else "") + self.pattern
        if self.output == "replace":
            return df.select("*", F.regexp_replace(c, p, self.replacement).alias(name + self.suffix))
        if self.output == "parse":
            return df.select("*", *[self._blank(F.regexp_extract(c, p, i)).try_cast(g.type).alias(g.name) for i, g in enumerate(self.groups or detected_groups(self.pattern, self.root), 1)])
        if self.output == "match":
            step = df.filter(c.rlike(p)) if self.only_matches else df
            return step.select("*", F.when(c.rlike(p), F.lit(1)).otherwise(F.lit(0)).alias(self.match_column))
        every = F.regexp_extract_all(c, F.lit(p), F.lit(1 if has_group(self.pattern) else 0))
        if self.tokenize_output == "splitRows":
            step = df.select("*", F.posexplode(every).alias("_millrace_p", self.root))
            step = step.select([names.col(x) for x in df.columns if x.lower() != self.root.lower()] + [names.col(self.root), (F.col("_millrace_p") + 1).alias("token_position")])
            return step if self.allow_blank else step.filter(names.col(self.root) != "")
        if self.tokenize_output != "splitColumns":
            return df.select("*", *[self._blank(F.regexp_extract(c, p, i)).alias(f"{self.root}{i}") for i in range(1, self.n + 1)])
        return self._split_columns(df, every)

    @staticmethod
    def _blank(x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    def _split_columns(self, df: DataFrame, every: Column) -> DataFrame:
        step = df.withColumn("_millrace_m", every)
        m = F.col("_millrace_m")
        found = F.size(m)
        out = []
        for i in range(1, self.n + 1):
            token = F.get(m, F.lit(i - 1))
            if self.extra == "saveAllRemainingText" and i == self.n:
                token = F.when(found >= self.n, F.array_join(F.slice(m, self.n, F.greatest(found - F.lit(self.n - 1), F.lit(0))), ""))
            token = F.coalesce(token, F.lit("")) if self.allow_blank else self._blank(token)
            token = F.when(found > 0, token)
            if self.extra == "dropExtraWithError":
                token = F.when(found > self.n, F.concat(F.lit("ERROR: Found "), found.cast("string"), F.lit(f" regex matches, but only {self.n} columns expected"))).otherwise(token)
            out.append(token.alias(f"{self.root}{i}"))
        return step.select([names.col(x) for x in df.columns] + out)


@dataclass(frozen=True)
class TextToColumns(Operator):
    """Splits text at a delimiter, taken literally, to columns or rows.

    splitColumns: ``<prefix>_<i>_<suffix>``; what is over stays in the last column
    or, with ``extra`` other than "Leave extra in last column", is dropped.
    splitRows: a row a token, with ``{}`` and ``_`` put as blanks.
    """

    column: str
    delimiter: str
    strategy: str = "splitColumns"
    n: int = 1
    extra: str = "Leave extra in last column"
    prefix: str = "root"
    suffix: str = "generated"
    rows_column: str = "generated_column"

    def problems(self, df: DataFrame) -> list[str]:
        out = needed(self.column, "column") + needed(self.delimiter, "delimiter") + absent(df, [self.column])
        if self.strategy == "splitColumns" and self.n < 1:
            out.append("n must be at least 1")
        return out + (needed(self.rows_column, "name of the rows' column") if self.strategy == "splitRows" else [])

    def apply(self, df: DataFrame) -> DataFrame:
        c = names.col(names.resolve(df, self.column)).cast("string")
        literal = re.sub(r"([^\w])", r"\\\1", self.delimiter)
        if self.strategy == "splitColumns":
            leave = self.extra == "Leave extra in last column"
            parts = F.split(c, literal, self.n if leave else -1)
            step = df.withColumn("_millrace_m", parts)
            return step.select([names.col(x) for x in df.columns] + [F.get("_millrace_m", F.lit(i)).alias(f"{self.prefix}_{i + 1}_{self.suffix}") for i in range(self.n)])
        if self.strategy == "splitRows":
            token = F.explode(F.split(F.coalesce(c, F.lit("")), literal)).alias("_millrace_m")
            kept = [names.col(x) for x in df.columns if x.lower() != self.rows_column.lower()]
            return df.select("*", token).select(*kept, F.regexp_replace("_millrace_m", "[{}_]", " ").alias(self.rows_column))
        return df


@dataclass(frozen=True)
class _Document(Operator):
    """Parses a column into ``<column>_parsed``, by a schema or a sample record."""

    column: str
    method: str = "parseFromSampleRecord"
    sample: str | None = None
    schema: str | None = None

    def problems(self, df: DataFrame) -> list[str]:
        out = absent(df, [self.column])
        if self.method not in ("parseFromSampleRecord", "parseFromSchema", "none", ""):
            out.append(f"unknown method {self.method!r}")
        return out + (needed(self.schema, "schema") if self.method == "parseFromSchema" else [])

    def _parsed(self, c: Column, schema: object) -> Column:
        raise NotImplementedError

    def _sampled(self, sample: str) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.column or self.method in ("none", "") or (self.method == "parseFromSampleRecord" and not self.sample):
            return df
        name = names.resolve(df, self.column)
        schema = self.schema if self.method == "parseFromSchema" else self._sampled(" ".join(self.sample.split("\n")))
        return df.select("*", self._parsed(names.col(name), schema).alias(f"{name}_parsed"))


class JSONParse(_Document):
    """JSON text to a struct; malformed records are null."""

    def _parsed(self, c: Column, schema: object) -> Column:
        return F.from_json(c, schema)

    def _sampled(self, sample: str) -> Column:
        return F.schema_of_json(F.lit(sample))


class XMLParse(_Document):
    """XML text to a struct; malformed records are null."""

    def _parsed(self, c: Column, schema: object) -> Column:
        return F.from_xml(c, schema)

    def _sampled(self, sample: str) -> Column:
        return F.schema_of_xml(F.lit(sample))
