"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence.  Over the length
histogram, which has at most ``CAPACITY`` entries whatever the corpus, the
program asks for the fewest configurations that cover all pieces.  Multiplicative
weights solve it: a length's price falls as it is covered, and the best
configurations under the prices are knapsacks, one dynamic program for all.  A round
covers no length by more than a step, and rounds go on until every length is covered
in full; where the cover is further than ``GAP`` from the lower bound that prices
and sizes give, it is made again in smaller steps.  The amounts are rounded to whole
sequences along their running sum, best fit in order of falling length packs what
that leaves, still on counts, and if best fit alone needs fewer sequences its packing
is taken.  The plan says what share of pieces configurations place.

Only that histogram goes to the driver and only the plan, bounded in the same way,
goes back.  Pieces find their place by rank within their length: counts by
(partition, length) give each partition its first rank, so that no length, however
common, meets in one task.

Defined results: null text is the empty text (one piece, the end mark alone);
repeated rows are packed like any others; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch, workers

CAPACITY = 2048
STEPS = (1 / 4, 1 / 8)
RATE = 0.2
NEAR = 0.03
GAP = 0.001
CACHE = 400_000
PROBE = 97
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

# White space beyond this set differs between pattern engines; texts with any are encoded whole.
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNSAFE = re.compile(r"^ | $|\s |[ ]\s")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Text to ids as little-endian 32-bit numbers, with a bounded memory of words.

    A space with no white space beside it starts a new word for the vocabulary's
    pattern, so such words are encoded alone and remembered.  That holds for byte-level
    vocabularies without a normaliser; texts of any other are encoded whole.  Where the
    package has the same vocabulary as ranks, new words go through those, once they have given the
    same ids as the vocabulary file for every ``PROBE``-th of its entries.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        before = spec.get("pre_tokenizer") or {}
        self.by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        own = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        ranked = self._ranked(path)
        probes = [self.tokenizer.decode([i], skip_special_tokens=True) for i in range(0, self.tokenizer.get_vocab_size(), PROBE)]
        self.ids_of = ranked if ranked and all(ranked(p) == own(p) for p in probes) else own

    @staticmethod
    def _ranked(path: str):
        """The encoder over ranks that lie beside the file, or None."""
        beside = Path(path).with_suffix(".tiktoken")
        if not beside.exists():
            return None
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, beside.read_bytes().splitlines())}
        return tiktoken.Encoding(beside.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            ids = self.ids_of(word)
            found = self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_words or any(s in text for s in self.special) or _EXOTIC.search(text):
            return self.whole(text)
        if _UNSAFE.search(text):
            return b"".join(map(self.word, _SAFE_CUT.split(text)))
        first, *rest = text.split(" ")
        get, word = self.known.get, self.word
        return b"".join([word(first), *[get(w) or word(w) for w in map(" ".__add__, rest)]])


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies has the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents; ``rank`` counts those of a length in the partition."""
    vocabulary = vocabulary or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    workers.ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                at, size, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, int(seen[size])))
                    seen[size] += 1
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Plan(NamedTuple):
    """Slots in order of (length, first rank): each has ``many`` sequences in turn.

    ``cover`` is the fractional cover's total, ``by_configurations`` the share of pieces that its configurations place.
    """

    length: np.ndarray
    first: np.ndarray
    many: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    at_least: int
    cover: float
    by_configurations: float


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the highest value of its content, and a length in that content or 0; ``value[l]`` is that of length ``l``, or -inf."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    # Lengths that shorter ones replace at no loss are left out of the sums.
    lengths, values, m = np.zeros(capacity, dtype=np.int64), np.zeros(capacity), 0
    for c in range(1, capacity + 1):
        top, at = best[c - 1], 0
        if m:
            sums = values[:m] + best[c - lengths[:m]]
            k = int(sums.argmax())
            if sums[k] > top:
                top, at = sums[k], lengths[k]
        if value[c] > top * (1 + 1e-12):
            top, at = value[c], c
            lengths[m], values[m] = c, top
            m += 1
        best[c], last[c] = top, at
    return best, last


def contents(heads: np.ndarray, last: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each length in ``heads`` the best configuration that has it."""
    found = [{int(n): 1} for n in heads]
    filled = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
    who, at = np.arange(len(heads)), filled[capacity - heads]
    while (at > 0).any():
        who, at = who[at > 0], at[at > 0]
        for i, n in zip(who.tolist(), last[at].tolist(), strict=True):
            found[i][n] = found[i].get(n, 0) + 1
        at = filled[at - last[at]]
    return found


def size_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed by sizes: long pieces share none, and short ones have the room these leave (Martello and Toth)."""
    size = np.arange(capacity + 1)
    many, total = np.append(0, counts.cumsum()), np.append(0, (counts * size).cumsum())  # of lengths below an index
    half, bound = capacity // 2 + 1, 0
    for a in range(capacity // 2 + 1):
        room = (many[capacity - a + 1] - many[half]) * capacity - (total[capacity - a + 1] - total[half])
        bound = max(bound, int(many[-1] - many[half]) + max(0, -int(-(total[half] - total[a] - room) // capacity)))
    return bound


def cover(counts: np.ndarray, capacity: int, step: float) -> tuple[dict[tuple, float], int]:
    """Amounts of configurations that cover every length in full and no more, and the best bound by prices."""
    size = np.arange(capacity + 1)
    left, bound = counts.astype(float), 0
    amounts: dict[tuple, float] = {}
    # Each round covers a length by its step or what is left of it, so rounds are at most lengths / step.
    while (left > 0).any():
        lengths = np.flatnonzero(left > 0)
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = size[lengths] * np.exp(RATE * left[lengths] / counts[lengths])
        best, last = knapsack(price, capacity)
        # Prices over the best value are feasible for the dual.
        bound = max(bound, int(np.ceil((price[lengths] * counts[lengths]).sum() / best[capacity] - 1e-6)))
        value = price[lengths] + best[capacity - lengths]
        heads = lengths[np.argsort(-value, kind="stable")][: int((value >= (1 - NEAR) * best[capacity]).sum())]
        most = np.minimum(left, step * counts)
        room = most.tolist()
        for found in contents(heads, last, capacity):
            amount = min(room[n] / k for n, k in found.items())
            if amount > 0:
                key = tuple(sorted(found.items(), reverse=True))
                amounts[key] = amounts.get(key, 0.0) + amount
                for n, k in found.items():
                    room[n] -= k * amount
                    if room[n] < 1e-9 * counts[n]:
                        room[n] = 0.0
        left -= most - np.array(room)
        left[left < 1e-9 * counts] = 0
    return amounts, bound


def configurations(counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], int]:
    """A fractional cover as (configuration, amount), and the best lower bound met."""
    best: dict[tuple, float] = {}
    bound = size_bound(counts, capacity)
    for step in STEPS if (counts > 0).any() else ():
        amounts, by_prices = cover(counts, capacity, step)
        bound = max(bound, by_prices)
        if not best or sum(amounts.values()) < sum(best.values()):
            best = amounts
        if sum(best.values()) <= (1 + gap) * bound:
            break
    return [(dict(k), x) for k, x in best.items()], bound


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in order of falling length, on counts: (configuration, how many)."""
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [content, how many]
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        room = n
        while left and room <= capacity:
            if not open_[room]:
                room += 1
                continue
            content, many = open_[room].pop()
            each = room // n
            full = min(many, left // each)
            if full:
                open_[room - each * n].append([content + ((n, each),), full])
                left -= full * each
            if many > full:
                if 0 < left < each:
                    open_[room - left * n].append([content + ((n, left),), 1])
                    left, many = 0, many - 1
                if many > full:
                    open_[room].append([content, many - full])
            if room < capacity and not left:
                break
        if left:
            each = capacity // n
            if left // each:
                open_[capacity - each * n].append([((n, each),), left // each])
            if left % each:
                open_[capacity - (left % each) * n].append([((n, left % each),), 1])
    return [(content, many) for groups in open_ for content, many in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> Plan:
    """Where the pieces of each length go; ``counts[l]`` is how many have length ``l``."""
    fractional, at_least = configurations(counts, capacity, gap)
    rest = counts.tolist()
    packed: list[tuple[tuple[tuple[int, int], ...], int]] = []
    # The fullest first; a fraction is carried to the next, and sequences are taken as long as pieces last.
    carry = 0.0
    for found, amount in sorted(fractional, key=lambda x: -sum(n * k for n, k in x[0].items())):
        carry += amount
        whole = int(carry + 1e-6)
        carry -= whole
        many = min(whole, *(rest[n] // k for n, k in found.items()))
        if many > 0:
            packed.append((tuple(found.items()), many))
            for n, k in found.items():
                rest[n] -= k * many
    share = 1 - sum(rest) / max(int(counts.sum()), 1)
    packed += best_fit(np.array(rest), capacity)
    alone = best_fit(counts, capacity)
    if sum(m for _, m in alone) < sum(m for _, m in packed):
        packed, share = alone, 0.0
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots, sequence = [], 0
    for content, many in packed:
        at = 0
        for n, k in content:
            slots.append((n, int(used[n]), many, sequence, at))
            used[n] += k * many
            at += n * k
        sequence += many
    slots.sort()
    columns = [np.array(c, dtype=np.int64) for c in (zip(*slots, strict=True) if slots else [()] * 5)]
    return Plan(*columns, sequence, at_least, sum(x for _, x in fractional), share)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, gap: float = GAP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    made = scratch.table(pieces(docs, capacity, vocabulary), "pack-pieces")
    by_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_part = scratch.table(by_part, "pack-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    todo = plan(counts, capacity, gap)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select(F.col("part").alias("_p"), F.col("length").alias("_l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    ranked = made.join(firsts, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_l"))).withColumn("rank", F.col("rank") + F.col("_first"))

    workers.ship(docs.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (todo.length << 44) + todo.first
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            slot = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            within = rank - todo.first[slot]
            sequence = todo.sequence[slot] + within % todo.many[slot]
            offset = todo.offset[slot] + within // todo.many[slot] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)
