"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, schemes, plus signs
and cue words.  From each, a local parser walks to the boundaries and validates:
mail addresses around an at-sign, credentials after a scheme, telephone numbers
from a plus sign, account numbers and street addresses after their cues.  Dotted
quads and card numbers have no anchor but their digits; possessive patterns find
those in linear time.

Defined results: null texts count as empty; offsets are code points, end
exclusive; repeated rows are scanned one by one; spans of the added kinds
stay beside base spans that they overlap; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import workers

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "credential", "account", "ssn", "street")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER = re.compile(r"[^\s:/@?#]++:[^\s/@?#]++@")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:number|no\.?|nr\.?))?[\s:#=]{1,3}([0-9][0-9-]{6,18}[0-9])(?![0-9])", re.I)
_SSN = re.compile(r"(?: (?i:number|no\.?|nr\.?))?[\s:#=]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
_STREET = re.compile(r"[\s:]{1,3}([0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd))\b")
_STRASSE = re.compile(r"[\s:]{1,3}((?:[A-ZÄÖÜ][a-zäöüß]*[ -])?[A-ZÄÖÜ]?[a-zäöüß]*(?:[Ss]traße|[Ss]trasse|[Ss]tr\.|[Ww]eg|[Pp]latz|[Aa]llee|[Gg]asse) [0-9]{1,4}[a-z]?)\b")

_CUES = {"@": "at", "://": "scheme", "+": "plus", "iban": "iban", "account": "account", "acct": "account", "konto": "account", "ssn": "ssn", "social security": "ssn", "address": "street", "adresse": "street"}
_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _automata:
        a = ahocorasick.Automaton()
        for cue, kind in _CUES.items():
            a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def _lower(text: str) -> str:
    """``text`` with ASCII letters in lower case and nothing else changed, so that offsets stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[Span]:
    """Spans (kind, start, end) in order of kind, then start."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    mail_end = phone_end = 0
    for last, (kind, size) in _automaton().iter(_lower(text)):
        at, after = last - size + 1, last + 1
        if kind == "at":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, after)):
                out["email"].append(("email", start, m.end()))
                mail_end = m.end()
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(("phone", at, m.end()))
        elif kind == "scheme":
            if m := _USER.match(text, after):
                out["credential"].append(("credential", after, m.end() - 1))
        elif kind == "iban":
            if (m := _IBAN.match(text, after)) and iban_valid(m[1]):
                out["account"].append(("account", m.start(1), m.end(1)))
        elif kind == "account":
            if m := _ACCOUNT.match(text, after):
                out["account"].append(("account", m.start(1), m.end(1)))
        elif kind == "ssn":
            if m := _SSN.match(text, after):
                out["ssn"].append(("ssn", m.start(1), m.end(1)))
        elif m := _STREET.match(text, after) or _STRASSE.match(text, after):
            out["street"].append(("street", m.start(1), m.end(1)))
    out["ip"] = [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    out["card"] = [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    base = [s for k in BASE for s in out[k]]
    return base + [s for k in KINDS[len(BASE) :] for s in sorted(set(out[k]))]


def redact(text: str, spans: Sequence[Span]) -> str:
    """``text`` with each span, or run of overlapping ones, put as its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end) for each row."""

    workers.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; null texts stay null."""
    at = docs.columns.index("text")

    workers.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, find(t)) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
