"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles, held as 64-bit hashes of them; sets
are compared by those, so two shingles of one pair that share a hash count as one (for
sets of a million, one pair in 30 million or so has any).  The
sketch throws each element into ``COORDINATES`` bins, once a round, each round
with its own hash; a bin keeps the least (round, hash).  After as many rounds as
there are bins, further rounds throw all elements into one bin each, so every
coordinate fills; a set of any size gets a sketch in O(t log t + size) with
concentration as good as for independent minima.

Texts of equal sets fall together first; one stands for all.  Coordinates, in two
orders, are cut into bands of ``ROWS``; texts with an equal band are candidates.
Candidates are never all pairs of a bucket.  Each member is compared with one hub,
the member whose own buckets hold the most, and components are formed; buckets that
still hold two of them go on.  There a bound that loses nothing rules out what can
have no partner: only shingles that more than one component has can be common to a
link between components, so a text with too few of those is done with.  Further
hubs follow while they still find links and much is left.  Then pairs of different
components in a bucket are tested by sizes, sketches and counts of such shingles by
the low bits of their hash, and only those that pass all bounds are emitted and
confirmed, so no link between components is lost for want of a hub.

Two texts share no band, the two orders not being independent, with probability about
5e-5 at a similarity of 0.80 and 1e-7 at 0.85; the one-bit filter is six deviations wide.

One text may be the hub of any share of all buckets, and one bucket may hold any share
of all texts.  Rows of a bucket carry its size, so joins on buckets deal them over a task for
each ``CHUNK`` of them; pairs carry the size of their hub's largest bucket, and a hub's set
goes once to each ``CHUNK`` of its pairs and not with every pair.  Of sets that more than one row in
``HOT`` has there are fewer than ``HOT``, so their components are broadcast.

Components come from alternating large and small stars over written tables, so
hubs of any degree combine map-side and nothing is gathered on the driver.

Defined results: null and empty texts have an empty set and link with nothing; a
text of fewer words than a shingle is one shingle; rows with null id get a null
component and are kept; repeated rows have equal sets and one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, workers

COORDINATES = 256
ROWS = 8
ORDERS = 2
PAIRS_PER_MEMBER = 30
WORTHWHILE = 0.01
CELLS = 64
HOT = 1000
CHUNK = 256
WORDS_KNOWN = 250_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 2 * COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = [np.random.default_rng(11 + i).permutation(COORDINATES) for i in range(ORDERS)]
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, max(64, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = np.arange(ORDERS * (COORDINATES // ROWS), dtype=np.uint64)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words, A-Z lowered."""
    words = (text or b"").lower().split()  # of bytes: only A-Z, and only the space and U+0009 to U+000D
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > WORDS_KNOWN:
        _words.clear()
    get, known = _words.get, _words
    h = np.array([get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w) | 1) for w in words], dtype=np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(_mix(total))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The coordinates of a set that is not empty."""
    t = COORDINATES
    out = np.full(t, _TOP, dtype=np.uint64)
    at, step = 0, max(1, min(64, -(-7 * t // len(elements))))
    while at < t:
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        h = _mix(elements[None, :] ^ _SEEDS[at : at + len(rounds), None])
        value = ((rounds[:, None] << np.uint64(54)) | (h >> np.uint64(10))).ravel()
        place = (h & np.uint64(t - 1)).ravel()
        order = np.argsort(value)[::-1]
        new = np.full(t, _TOP, dtype=np.uint64)
        new[place[order]] = value[order]  # the least comes last and stays
        out = np.minimum(out, new)
        at += len(rounds)
        if out.max() != _TOP:
            return out
    for i in np.flatnonzero(out == _TOP):
        out[i] = (np.uint64(t + i) << np.uint64(54)) | (_mix(elements ^ _SEEDS[t + i]).min() >> np.uint64(10))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = np.concatenate([coordinates[p].reshape(-1, ROWS) for p in _PLACES])
    return _mix((rows * _FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64) + _BANDS * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _one_bit(coordinates: np.ndarray) -> np.ndarray:
    return np.packbits((_mix(coordinates) & np.uint64(1)).astype(np.uint8)).view(np.int64)


_SKETCHES = "doc_id long, n_shingles long, d1 long, d2 long, " + ", ".join(f"s{i} long" for i in range(COORDINATES // 64)) + ", bands array<long>"


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """One row a document: set size, digest of the set, one-bit sketch and band keys."""

    workers.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            last: dict[bytes, tuple] = {}
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), size)
                if not len(s):
                    rows.append((0, 0, 0, *[0] * (COORDINATES // 64), None))
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest not in last:
                    c = sketch(s)
                    last[digest] = (*np.frombuffer(digest, dtype=np.int64).tolist(), *_one_bit(c).tolist(), band_keys(c))
                rows.append((len(s), *last[digest]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (4 + COORDINATES // 64)
            types = [pa.int64()] * (len(columns) - 1) + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_shingles", "d1", "d2", *[f"s{i}" for i in range(COORDINATES // 64)], "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCHES)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, set``: the shingle hashes, sorted."""

    workers.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "node long, set array<long>")


def _chunks(n: str) -> Column:
    return F.ceil(F.col(n) / CHUNK).cast("int")


def _salted(many: DataFrame, n: str, by: str) -> DataFrame:
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), _chunks(n)).cast("int"))


def _copied(single: DataFrame, n: str) -> DataFrame:
    return single.withColumn("_salt", F.explode(F.sequence(F.lit(0), _chunks(n) - 1)))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``a, b`` whose sets have at least ``percent`` similarity; ``b`` is in about ``size`` pairs, the same for each of them."""

    workers.ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            hold = []
            for i in range(batch.num_rows):
                a, b = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                hold.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(hold, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    asked = pairs.groupBy("b").agg(F.max("size").alias("size")).join(right, "b")
    return _salted(pairs.join(left, "a"), "size", "a").join(_copied(asked, "size").drop("size"), ["b", "_salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b): the least node it reaches."""

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        # Large star: over all neighbours, larger ones move to the least. Small star: smaller ones do.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        moved = both.join(least, F.col("u") == F.col("_u"))
        if large:
            out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = scratch.table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "dup-edges")
    before = mark(edges)
    while before[0]:
        edges = scratch.table(stars(stars(edges, True), False), "dup-edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _apart() -> Column:
    """Bits in which the one-bit sketches of ``p`` and ``q`` differ."""
    total = F.lit(0)
    for i in range(COORDINATES // 64):
        total = total + F.bit_count(F.col(f"p.s{i}").bitwiseXOR(F.col(f"q.s{i}")))
    return total


def _possible(percent: int) -> Column:
    """Whether sizes and one-bit sketches of ``p`` and ``q`` allow the threshold."""
    differ = (100 - percent) / 200
    limit = COORDINATES * differ + 6 * (COORDINATES * differ * (1 - differ)) ** 0.5
    fits = F.lit(100) * F.least("p.n_shingles", "q.n_shingles") >= F.lit(percent) * F.greatest("p.n_shingles", "q.n_shingles")
    return fits & (_apart() <= F.lit(int(limit) + 1))


def _open(now: DataFrame) -> DataFrame:
    """Those rows of ``band, node, n, c`` whose band has two components or more."""
    bands = now.groupBy("band").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.max("n").alias("n")).filter("_lo != _hi").select("band", "n")
    return _salted(now, "n", "node").join(_copied(bands, "n").drop("n"), ["band", "_salt"], "left_semi").drop("_salt")


def shared_counts(live: DataFrame, full_sets: DataFrame) -> DataFrame:
    """``node, m, cells`` of ``live`` (band, node, c): its shingles that other components have.

    ``m`` is their number and ``cells`` their numbers by the low bits of the hash.
    Nodes without any are left out.
    """
    each = live.select("node", "c").distinct().join(full_sets, "node").select("node", "c", F.explode("set").alias("s"))
    shared = each.groupBy("s").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo != _hi").select("s")
    cells = each.join(shared, "s", "left_semi").groupBy("node", F.col("s").bitwiseAND(F.lit(CELLS - 1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    by_node = cells.groupBy("node").agg(F.sum("n").alias("m"), F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("_cells"))
    every = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.coalesce(F.try_element_at("_cells", k.cast("long")), F.lit(0).cast("long")).cast("int"))
    return by_node.select("node", "m", every.alias("cells"))


def viable(live: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Those rows of ``live`` that can have a link to another component in their band.

    A link's common shingles are at most ``m`` of either side, at least ``percent``
    of the larger set, and of both sets the share that the threshold asks for; the
    other set is no smaller than the smallest of the band.
    """
    m, n = F.col("m"), F.col("n_shingles")
    step = live.join(own.select("node", "m", "n_shingles"), "node").filter(F.lit(100) * m >= F.lit(percent) * n)
    bands = step.groupBy("band").agg(F.min("n_shingles").alias("_least"), F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.max("n").alias("n")).filter("_lo != _hi").select("band", "n", "_least")
    other = F.greatest(F.col("_least"), F.ceil(F.lit(percent) * F.col("n_shingles") / F.lit(100)))
    step = _salted(step, "n", "node").join(_copied(bands, "n").drop("n"), ["band", "_salt"])
    return step.filter(F.lit(100 + percent) * m >= F.lit(percent) * (n + other)).select("band", "node", "n", "c").distinct()


def _overlap(percent: int) -> Column:
    """Whether the shared shingles of ``p`` and ``q`` can be enough for the threshold."""
    needed = F.lit(percent) * (F.col("p.n_shingles") + F.col("q.n_shingles"))
    both = F.aggregate(F.zip_with("p.cells", "q.cells", lambda a, b: F.least(a, b)), F.lit(0), lambda acc, x: acc + x)
    return (F.lit(100 + percent) * F.least("p.m", "q.m") >= needed) & _possible(percent) & (F.lit(100 + percent) * both >= needed)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Links join documents whose shingle sets have at least ``percent`` similarity;
    ``component_id`` is the smallest id reachable and ``kept`` marks its document.
    """
    with scratch.only(docs.sparkSession, "dup-sketches", "dup-ids"):
        rows, ids = _components_of_sets(docs, size, percent)
    # Sets first, one row each, then rows.
    hot = F.broadcast(ids.filter("_hot").select("_digest", "_c"))
    own = rows.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.struct("d1", "d2")).alias("_digest"))
    some = own.filter("_digest IS NOT NULL")
    out = some.join(hot, "_digest").union(some.join(hot.select("_digest"), "_digest", "left_anti").join(ids.filter("NOT _hot").select("_digest", "_c"), "_digest"))
    out = out.drop("_digest").union(own.filter("_digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("_c")))
    return out.select("doc_id", "n_shingles", F.col("_c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("_c"), F.lit(True)).alias("kept"))


def _components_of_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and ``_digest, _hot, _c``: each set's component and whether more than one row in ``HOT`` has it."""
    bits = [f"s{i}" for i in range(COORDINATES // 64)]
    rows = scratch.table(sketches(docs, size), "dup-sketches")
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = scratch.table(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "dup-nodes")
    n_full = nodes.agg(F.sum("copies")).first()[0] or 0
    # The ids that stand for a set are one row a set, so this join has no hot key but an id that repeats.
    chosen = full.join(nodes.drop("copies").withColumnsRenamed({"d1": "_d1", "d2": "_d2"}), (F.col("doc_id") == F.col("node")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left_semi").withColumnRenamed("doc_id", "node")
    banded = chosen.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo != _hi").select("band", "n")
    members = scratch.table(banded.join(buckets, "band").distinct(), "dup-members")
    active = scratch.table(members.groupBy("node").agg(F.sum("n").alias("score")), "dup-active")
    # Ids stand for their texts only where they are unique; a repeated id's texts are all compared.
    info = scratch.table(chosen.join(active.select("node"), "node", "left_semi").select("node", "n_shingles", *bits).distinct(), "dup-info")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(active.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    full_sets = scratch.table(sets(texts, size), "dup-sets")
    p = info.alias("p")

    def linked(live: DataFrame) -> DataFrame:
        pairs = with_hub(live, info.select(F.col("node").alias("b"), F.struct("n_shingles", *bits).alias("q")))
        near = pairs.join(p, F.col("a") == F.col("p.node")).filter(_possible(percent)).select("a", "b", "size").distinct()
        return confirmed(scratch.table(near, "dup-near"), full_sets, percent)

    links, comp, turn = None, None, 0
    live = members.join(active, "node").select("band", "node", "n", F.col("node").alias("c"), F.col("score").alias("rank"))
    while True:
        new = scratch.table(linked(live), "dup-links")
        found = new.count()
        links = new if links is None else links.union(new)
        comp = components(links) if found else comp
        now = live.select("band", "node", "n")
        now = now.join(comp, "node", "left") if comp is not None else now.withColumn("component", F.lit(None).cast("long"))
        live = scratch.table(_open(now.select("band", "node", "n", F.coalesce("component", "node").alias("c"))), "dup-live")
        own = scratch.table(info.join(shared_counts(live, full_sets), "node"), "dup-shared")
        live = scratch.table(viable(live, own, percent), "dup-live")
        sizes = live.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        texts_left = live.select("node").distinct().count()
        left = sizes.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n") - F.col("own")) / 2).alias("cross")).first()
        if not left["cross"]:
            break
        if left["cross"] <= PAIRS_PER_MEMBER * left["n"] or found < WORTHWHILE * texts_left:
            side = scratch.table(live.drop("n").join(own, "node"), "dup-side")
            x, y = side.alias("p"), side.alias("q")
            apart = (F.col("p.band") == F.col("q.band")) & (F.col("p.node") > F.col("q.node")) & (F.col("p.c") != F.col("q.c"))
            pairs = x.join(y, apart & _overlap(percent)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
            pairs = scratch.table(pairs, "dup-pairs")
            sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
            new = scratch.table(confirmed(pairs.join(sizes, "b"), full_sets, percent), "dup-links")
            comp = components(links.union(new)) if new.head(1) else comp
            break
        turn += 1
        live = live.withColumn("rank", F.xxhash64(F.lit(turn), "node"))
    ids = nodes.withColumn("_c", F.col("node")) if comp is None else nodes.join(comp, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    return rows, scratch.table(ids.select(F.struct("d1", "d2").alias("_digest"), (F.col("copies") * HOT > n_full).alias("_hot"), "_c"), "dup-ids")


def with_hub(live: DataFrame, info: DataFrame) -> DataFrame:
    """``a, b, size, q``: each band's members with the one of highest rank, where components differ.

    ``size`` is that of the hub's largest band and ``q`` what ``info`` (b, q) has of the hub.
    """
    hubs = live.groupBy("band").agg(F.max(F.struct("rank", "node", "c")).alias("_hub"), F.max("n").alias("n"))
    hubs = scratch.table(hubs.select("band", F.col("_hub")["node"].alias("b"), F.col("_hub")["c"].alias("_hub_c"), "n"), "dup-hubs")
    own = hubs.groupBy("b").agg(F.max("n").alias("size")).join(info, "b")
    pairs = _salted(live, "n", "node").join(_copied(hubs.join(own, "b"), "n").drop("n"), ["band", "_salt"]).filter(F.col("c") != F.col("_hub_c"))
    return pairs.select(F.col("node").alias("a"), "b", "size", "q")
