"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors of whole numbers are cut into segments.  A segment's mean and deviation
bound its part of an inner product from above (for distances: from below):
``n * mean_q * mean_x + dev_q * dev_x``, where ``dev`` is the length of what is
left when the mean is taken off.  A query first gets exact scores for the rows whose
means at the finest level promise most; the k-th best of those is its floor.  Then
one segment, four, sixteen, sixty-four: at each level the rows whose bound is under the
query's own floor are dropped for that query, and what survives the finest level gets
exact scores.  Queries alike at the finest level go side by side, so that a batch
drops rows as a whole before the next level's products.

Queries against all rows go block by block: queries fall into blocks and so do
candidates, and a pair of blocks is one group.  Blocks hold a set number of bytes, so
a group's memory is bounded whatever the vectors' length; each row is sent once to each
block of queries.  Each group returns k rows a query, which are ranked in a window.

Defined results: vectors that are null or hold a null or non-finite component, and
rows with a null id, take no part; vectors of different lengths are not compared;
rows that share the query's id are not its candidates; other rows that repeat are
candidates each, ties to the smaller id; scores beyond 64 bits stop at the ends.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import workers

K = 20
SCALE = 64.0
QUERY_BYTES, ROW_BYTES = 32 << 20, 16 << 20
LEVELS = (1, 4, 16, 64)
BATCH = 64
PROMISING = 4
DENSE = 0.2
FOUND = "query_id long, vec_id long, score long"
_EXACT = float(1 << 53)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, each times the root of its segment's length, then deviations."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    means = np.stack([p.sum(1) / math.sqrt(p.shape[1]) for p in parts], 1)
    # The square of the deviation, by difference; a little more, so that the bound holds in floating point.
    squares = np.stack([(p * p).sum(1) for p in parts], 1)
    return np.concatenate([means, np.sqrt(np.maximum(squares - means * means, 0) + 1e-9 * squares)], 1)


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; 64-bit, at the ends if beyond."""
    if np.abs(q).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1]) < _EXACT:
        return (rows @ q).astype(np.int64)
    wide = rows.astype(object) if rows.dtype != object else rows
    whole = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in wide]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in whole], dtype=np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K, seen: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best rows, ties to the smaller id.

    ``seen`` (one number more than ``LEVELS``) is increased by the pairs of query and
    row at the start and by those that survive each level.
    """
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) >= _EXACT:
        return [_best(ids[ids != own], _scores(v, x[ids != own]), k) for own, v in zip(q_ids, q, strict=True)]
    # Statistics of segments shorter than four are no cheaper than the scores.
    levels = [s for s in LEVELS if 4 * s <= x.shape[1]] or LEVELS[:1]
    of_rows = [segment_statistics(x, s) for s in levels]
    of_queries = [segment_statistics(q, s) for s in levels]
    # Queries with the same signs of their means, the first segments first, are neighbours.
    means = of_queries[-1][:, : of_queries[-1].shape[1] // 2]
    order = np.lexsort((means > np.median(means, 0)).T[::-1]) if len(q) else np.arange(0)
    out: list = [None] * len(q)
    for a in range(0, len(q), BATCH):
        part = order[a : a + BATCH]
        for i, best in zip(part, _search_batch(q_ids[part], q[part], [s[part] for s in of_queries], ids, x, of_rows, k, seen), strict=True):
            out[i] = best
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id; a bitwise not turns the order without overflow."""
    best = np.lexsort((ids, ~scores))[:k]
    return ids[best], scores[best]


def _floors(q_ids: np.ndarray, q: np.ndarray, means: np.ndarray, ids: np.ndarray, x: np.ndarray, row_means: np.ndarray, k: int) -> np.ndarray:
    """A score that k rows of each query reach; -inf where fewer than k rows are at hand."""
    many = min(len(x), PROMISING * k + 1)
    promise = means @ row_means.T
    rows = np.argpartition(promise, len(x) - many, 1)[:, len(x) - many :]
    scores = np.einsum("qrd,qd->qr", x[rows], q)
    scores[ids[rows] == q_ids[:, None]] = -np.inf
    return np.partition(scores, many - k, 1)[:, many - k] if many >= k else np.full(len(q), -np.inf)


def _search_batch(q_ids: np.ndarray, q: np.ndarray, of_queries: list[np.ndarray], ids: np.ndarray, x: np.ndarray, of_rows: list[np.ndarray], k: int, seen: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """A few queries against all rows, with a matrix product at every level."""
    half = of_rows[-1].shape[1] // 2
    floor = _floors(q_ids, q, of_queries[-1][:, :half], ids, x, of_rows[-1][:, :half], k)
    # Bounds and floors are sums of whole numbers below 2**53 and of roots; the margin is far above their rounding.
    least = (floor - 1e-6 * (1 + np.abs(floor)))[:, None]
    rows, open_ = np.arange(len(x)), np.ones((len(q), len(x)), dtype=bool)
    counts = [open_.sum()]
    for sq, sx in zip(of_queries, of_rows, strict=True):
        open_ &= sq @ sx[rows].T >= least
        some = open_.any(0)
        if not some.all():
            rows, open_ = rows[some], open_[:, some]
        counts.append(open_.sum())
    if seen is not None:
        seen[: len(counts)] += np.array(counts, dtype=np.int64)
        seen[len(counts) :] += int(counts[-1])
    # Where most pairs are left, one product for all costs less than a product for each query's own rows.
    dense = q @ x[rows].T if open_.size and open_.mean() > DENSE else None
    out = []
    for i, own in enumerate(q_ids):
        mine = np.flatnonzero(open_[i])
        scores = dense[i, mine] if dense is not None else x[rows[mine]] @ q[i]
        keep = (scores >= floor[i]) & (ids[rows[mine]] != own)
        out.append(_best(ids[rows[mine[keep]]], scores[keep].astype(np.int64), k))
    return out


def blocks(n: int, length: int, every: int) -> tuple[int, int]:
    """How many blocks of rows and of queries ``n`` vectors make."""
    size = 8 * max(1, length)
    return max(1, -(-n * size // ROW_BYTES)), max(1, -(-n * size // (every * QUERY_BYTES)))


def top_k(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: rows with ``vec_id % every = 0`` against all."""
    parts = F.transform("embedding", lambda c: c.cast("double"))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"))
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    row_blocks, query_blocks = blocks(n, longest or 1, every)
    spread = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(m)).cast("int")
    left = asked.select("vec_id", "v", spread(1, query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    right = rows.select("vec_id", "v", spread(2, row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    workers.ship(vectors.sparkSession)

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = []
        sizes = q["v"].map(len).to_numpy() if len(q) else np.array([], int)
        x_sizes = x["v"].map(len).to_numpy() if len(x) else np.array([], int)
        for size in np.unique(sizes):
            mine, theirs = q[sizes == size], x[x_sizes == size]
            if not len(theirs):
                continue
            qs, xs = (np.floor(SCALE * np.stack(t["v"].to_numpy()).astype(np.float64)).reshape(len(t), size) for t in (mine, theirs))
            if not size:
                qs, xs = np.zeros((len(mine), 1)), np.zeros((len(theirs), 1))
            for own, (ids, scores) in zip(mine["vec_id"], search_block(mine["vec_id"].to_numpy(), qs, theirs["vec_id"].to_numpy(), xs, k), strict=True):
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(pair, FOUND)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
