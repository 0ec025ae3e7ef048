"""Cleansing, masking and encoding of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import literals, names
from ..core.base import Operator, absent, needed


@dataclass(frozen=True)
class DataCleansing(Operator):
    """Cleans columns by type, each step in a fixed order; types stay as they were.

    Strings: fill nulls, trim spaces, collapse white space, remove white space,
    letters, punctuation, digits, then case (lower, upper, title).  Numbers, dates
    and timestamps: fill nulls.  ``drop_null_rows`` first drops all-null rows.
    """

    columns: Sequence[str] = ()
    drop_null_rows: bool = False
    fill_text: bool = False
    text_value: str = "NA"
    fill_number: bool = False
    number_value: float = 0
    trim: bool = False
    collapse_spaces: bool = False
    remove_spaces: bool = False
    remove_letters: bool = False
    remove_punctuation: bool = False
    remove_digits: bool = False
    case: str = "keep"
    fill_date: bool = False
    date_value: str = "1970-01-01"
    fill_timestamp: bool = False
    timestamp_value: str = "1970-01-01 00:00:00.0"

    def problems(self, df: DataFrame) -> list[str]:
        out = absent(df, self.columns)
        if self.fill_date and not literals.is_date(self.date_value):
            out.append(f"{self.date_value!r} is not a date")
        if self.fill_timestamp and not literals.is_timestamp(self.timestamp_value):
            out.append(f"{self.timestamp_value!r} is not a timestamp")
        if self.case not in ("keep", "lower", "upper", "title"):
            out.append(f"unknown case {self.case!r}")
        return out

    def _cleaned(self, c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.NumericType):
            return F.coalesce(c, literals.typed(self.number_value, kind)) if self.fill_number else c
        if isinstance(kind, T.DateType):
            return F.coalesce(c, literals.typed(self.date_value, kind)) if self.fill_date else c
        if isinstance(kind, literals.TIMES):
            return F.coalesce(c, literals.typed(self.timestamp_value, kind)) if self.fill_timestamp else c
        if not isinstance(kind, T.StringType):
            return c
        steps: list[tuple[bool, Callable[[Column], Column]]] = [
            (self.fill_text, lambda x: F.coalesce(x, F.lit(self.text_value))),
            (self.trim, F.trim),
            (self.collapse_spaces, lambda x: F.regexp_replace(x, r"\s+", " ")),
            (self.remove_spaces, lambda x: F.regexp_replace(x, r"\s+", "")),
            (self.remove_letters, lambda x: F.regexp_replace(x, r"[A-Za-z]+", "")),
            (self.remove_punctuation, lambda x: F.regexp_replace(x, r"[^a-zA-Z0-9\s]", "")),
            (self.remove_digits, lambda x: F.regexp_replace(x, r"\d+", "")),
            (self.case == "lower", F.lower),
            (self.case == "upper", F.upper),
            (self.case == "title", F.initcap),
        ]
        for wanted, step in steps:
            c = step(c) if wanted else c
        return c

    def apply(self, df: DataFrame) -> DataFrame:
        if self.drop_null_rows:
            df = df.filter(~F.forall(F.array(*[names.col(c).isNull() for c in df.columns]), lambda x: x))
        own = set(names.resolve_all(df, self.columns))
        return df.select([self._cleaned(names.col(f.name), f.dataType).cast(f.dataType).alias(f.name) if f.name in own else names.col(f.name) for f in df.schema]) if own else df


def placed(df: DataFrame, columns: Sequence[str], made: Callable[[str], Column], naming: str, affix_option: str, affix: str) -> DataFrame:
    """In place, keeping the order, or beside the originals with an affix."""
    own = names.resolve_all(df, columns)
    if naming == "inplace_substitute":
        return df.select([made(c).alias(c) if c in own else names.col(c) for c in df.columns])
    named = lambda c: affix + c if affix_option.lower() == "prefix" else c + affix
    return df.select("*", *[made(c).alias(named(c)) for c in own])


@dataclass(frozen=True)
class DataMasking(Operator):
    """Masks or hashes columns: mask, hash, sha2, sha, md5 or crc32.

    For ``mask`` each class of characters has a substitute; '' is the default (X,
    x, n; others stay) and "NULL" keeps the class.  ``combined`` hashes all columns
    into one new column of that name.
    """

    columns: Sequence[str]
    method: str
    upper: str = ""
    lower: str = ""
    digit: str = ""
    other: str = ""
    bits: int = 256
    naming: str = "inplace_substitute"
    affix_option: str = "Prefix"
    affix: str = ""
    combined: str = ""

    METHODS = ("mask", "hash", "sha2", "sha", "md5", "crc32")

    def problems(self, df: DataFrame) -> list[str]:
        out = needed(self.columns, "at least one column") + absent(df, self.columns)
        if self.method not in self.METHODS:
            out.append(f"unknown method {self.method!r}")
        if self.method == "sha2" and self.bits not in (224, 256, 384, 512):
            out.append("bits must be 224, 256, 384 or 512")
        for name in ("upper", "lower", "digit", "other"):
            if (v := getattr(self, name)) != "NULL" and len(v) > 1:
                out.append(f"{name} must be one character or NULL")
        if self.naming == "prefix_suffix_substitute":
            out += needed(self.affix, "prefix or suffix")
        if self.naming == "combinedHash_substitute":
            out += needed(self.combined, "name of the combined column")
            if self.method != "hash":
                out.append("only hash combines columns")
        return out

    def _masked(self, name: str) -> Column:
        c, text = names.col(name), names.col(name).cast("string")
        if self.method == "mask":
            pick = lambda v, default: None if v == "NULL" else (v or default)
            put = lambda v: F.lit(None).cast("string") if v is None else F.lit(v)
            return F.mask(text, put(pick(self.upper, "X")), put(pick(self.lower, "x")), put(pick(self.digit, "n")), put(pick(self.other, None)))
        return {"hash": lambda: F.hash(c), "sha2": lambda: F.sha2(text, self.bits), "sha": lambda: F.sha1(text), "md5": lambda: F.md5(text), "crc32": lambda: F.crc32(text)}[self.method]()

    def apply(self, df: DataFrame) -> DataFrame:
        if self.naming == "combinedHash_substitute":
            return df.select("*", F.hash(*[names.col(c) for c in names.resolve_all(df, self.columns)]).alias(self.combined))
        return placed(df, self.columns, self._masked, self.naming, self.affix_option, self.affix)


@dataclass(frozen=True)
class DataEncoderDecoder(Operator):
    """Encodes or decodes: base64, unbase64, hex, unhex, encode, decode, and AES.

    ``key``, ``iv`` and ``aad`` are values or functions that give them when the
    plan is made.  ``try_aes_decrypt`` gives null where decryption fails.  An empty
    method passes the input through.
    """

    columns: Sequence[str]
    method: str = ""
    charset: str = "UTF-8"
    naming: str = "inplace_substitute"
    affix_option: str = "Prefix"
    affix: str = "new_"
    mode: str = "GCM"
    key: str | Callable[[], str] = ""
    iv: str | Callable[[], str] = ""
    aad: str | Callable[[], str] = ""

    METHODS = ("", "base64", "unbase64", "hex", "unhex", "encode", "decode", "aes_encrypt", "aes_decrypt", "try_aes_decrypt")
    CHARSETS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16")

    def problems(self, df: DataFrame) -> list[str]:
        out = needed(self.columns, "at least one column") + absent(df, self.columns)
        if self.method not in self.METHODS:
            out.append(f"unknown method {self.method!r}")
        if self.method in ("encode", "decode") and self.charset not in self.CHARSETS:
            out.append(f"unknown charset {self.charset!r}")
        if "aes" in self.method:
            out += needed(self.key, "key")
            if self.mode not in ("GCM", "CBC", "ECB"):
                out.append(f"unknown mode {self.mode!r}")
        return out

    def _coded(self, name: str) -> Column:
        c = names.col(name)
        value = lambda v: F.lit((v() if callable(v) else v)).cast("binary")
        if self.method in ("aes_encrypt", "aes_decrypt", "try_aes_decrypt"):
            key, mode, padding = value(self.key), F.lit(self.mode), F.lit("DEFAULT")
            aad = value(self.aad) if self.aad else None
            if self.method == "aes_encrypt":
                iv = value(self.iv) if self.iv else None
                more = [iv, aad] if aad is not None and iv is not None else [iv] if iv is not None else []
                return F.base64(F.aes_encrypt(c.cast("string"), key, mode, padding, *more))
            decrypt = F.aes_decrypt if self.method == "aes_decrypt" else F.try_aes_decrypt
            return decrypt(F.unbase64(c), key, mode, padding, *([aad] if aad is not None else [])).cast("string")
        return {
            "base64": lambda: F.base64(c.cast("string")),
            "unbase64": lambda: F.unbase64(c).cast("string"),
            "hex": lambda: F.hex(c),
            "unhex": lambda: F.decode(F.unhex(c), "UTF-8"),
            "encode": lambda: F.encode(c.cast("string"), self.charset),
            "decode": lambda: F.decode(c, self.charset),
        }[self.method]()

    def apply(self, df: DataFrame) -> DataFrame:
        return placed(df, self.columns, self._coded, self.naming, self.affix_option, self.affix) if self.method else df
