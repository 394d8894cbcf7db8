"""N-gram Jaccard join in size-banded tiles, with hashed bitmap signatures.

A document is its set of word shingles.  Sizes fall into bands; two sets of a
band that are similar enough differ in at most D shingles, so of D + 1 hashed
parts of the shingles at least one is the same in both.  A tile is a band, a
part and the content of that part; all similar pairs meet in a tile, and none
is lost.  (Parts may be empty: E spare parts make up for up to E empty ones,
and a set with more of them also enters tiles of its empty parts.)

Parity bitmaps bound the overlap of two sets from above: |A xor B| is at least
the popcount of the bitmaps' xor.  In a tile every set is paired with one hub;
the pairs that pass the bound are verified by exact intersection of sorted
arrays.  What the verified links leave unconnected within a tile is compared
pair by pair: first, in some of the tiles, each set is verified with the one
set of another component that it may overlap most; then, with the components
that this leaves, all pairs of all tiles that pass the bound are.  Equal sets are one class from the start, named by a 64-bit
digest; components are found by contraction and named by least document id.

Hot groups: a batch sends each tile key once with its local hub, hubs with many
members, tiles with many sets, classes with many documents and components with
many classes are split into cells of bounded size.

Defined results: null text counts as empty; an empty set is linked with nothing
and is its own component; repeated rows of one id share a component if their
texts do; a null id never names a component unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, hot, scratch
from . import text as tx

SHINGLE, PERCENT, RATIO = 4, 85, 1.6
CHUNK_BYTES, FLUSH_ROWS = 1 << 20, 700_000
HUB_MEMBERS, CELL, NEAREST_TILES = 1000, 1500, 8
#: classes whose ids are broadcast to fetch their texts; a shuffled join beyond
BROADCAST_IDS = 1_000_000


class Bands:
    """Bands of set sizes; for each the number of parts and of spare ones."""

    def __init__(self, percent: int = PERCENT, ratio: float = RATIO):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
        self.low = np.array(self.low, np.int64)
        a = self.low[1:] - 1
        worst = self.most_different(a, a * 100 // percent)
        self.parts, self.spare = worst + 1, np.zeros(len(a), np.int64)
        for _ in range(6):  # spare parts for the empty ones that the smallest sets of a band have
            empty = self.parts * np.exp(-self.low[:-1] / self.parts)
            self.spare = np.where(worst > 0, np.ceil(empty + 3 * np.sqrt(empty)), 0).astype(np.int64)
            self.parts = worst + 1 + self.spare

    def most_different(self, a, b):
        """Largest symmetric difference of similar sets of sizes a and b."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def sets_of(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their text, set sizes) of distinct shingles, texts in order."""
    size = len(offs) - 1
    raw = tx.LOWER[raw]
    starts, ends, bounds = tx.words(raw, offs, tx.NONSPACE)
    h = tx.span_hash(tx.prefix_hash(raw), starts, ends)
    doc = tx.repeat_index(bounds)
    n = np.diff(bounds)
    s = tx.shingles(h, k)
    inside = np.flatnonzero(doc[: len(s)] == doc[k - 1 :]) if len(s) else np.zeros(0, np.int64)
    hs, ds = s[inside], doc[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            here = n[short] > j
            extra[here] += h[bounds[short[here]] + j] * tx.SHINGLE_CODES[j]
        extra = tx.mix(extra ^ n[short].astype(np.uint64))
        hs, ds = np.concatenate([hs, extra]), np.concatenate([ds, short])
        by = np.argsort(ds, kind="stable")
        hs, ds = hs[by], ds[by]
    key = hs ^ tx.mix(ds.astype(np.uint64) + tx.U64(1))
    by = np.argsort(key)
    first = np.ones(len(by), bool)
    first[1:] = key[by[1:]] != key[by[:-1]]
    keep = np.zeros(len(by), bool)
    keep[by[first]] = True
    hs, ds = hs[keep], ds[keep]
    return hs, ds, np.bincount(ds, minlength=size)


def _sums(group: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Order-free digest of the hashes of each group (sums of both halves, exact in doubles)."""
    lo = np.bincount(group, (h & tx.U64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    hi = np.bincount(group, (h >> tx.U64(32)).astype(np.float64), n).astype(np.uint64)
    return tx.mix(tx.mix(lo * tx.U64(0x9E3779B97F4A7C15)) ^ hi)


def classes_of(hs: np.ndarray, ds: np.ndarray, n: np.ndarray) -> np.ndarray:
    return tx.mix(_sums(ds, hs, len(n)) + n.astype(np.uint64)).view(np.int64)


def tile_keys(hs: np.ndarray, ds: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every tile that the sets enter."""
    full = np.flatnonzero(n > 0)
    top, low = bands.of(n[full]), bands.of(-(-n[full] * bands.percent // 100))
    reps = top - low + 1
    entry_doc = np.repeat(full, reps)
    entry_band = np.repeat(top, reps) - (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
    m = bands.parts[entry_band]
    base = np.concatenate([[0], np.cumsum(m)])
    start = np.concatenate([[0], np.cumsum(n)])
    count = n[entry_doc]
    item = np.repeat(start[entry_doc] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    entry = np.repeat(np.arange(len(entry_doc)), count)
    h = hs[item]
    part = ((tx.mix(h + tx.U64(0x51)) >> tx.U64(32)) * m[entry].astype(np.uint64)) >> tx.U64(32)
    group = base[entry] + part.astype(np.int64)
    total = int(base[-1])
    digest = _sums(group, h, total)
    of = np.repeat(np.arange(len(m)), m)
    filled = np.bincount(group, minlength=total)
    empty = np.bincount(of[filled == 0], minlength=len(m))
    place = (np.arange(total) - base[of]).astype(np.uint64)
    key = tx.mix(digest + tx.mix(place + (entry_band[of].astype(np.uint64) << tx.U64(40)) + tx.U64(7)))
    keep = (filled > 0) | (empty > bands.spare[entry_band])[of]
    return key[keep], entry_doc[of][keep]


def _group(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their hub (least class); and key, class, hub of the keys with several classes."""
    by = np.argsort(key)
    key, cls = key[by], cls[by]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] |= same
    several[:-1] |= same
    one_k, one_c = key[~several], cls[~several]
    k, c = key[several], cls[several]
    by = np.lexsort((c, k))
    k, c = k[by], c[by]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    k, c = k[new], c[new]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(k)))
    hub = np.repeat(c[at], size)
    multi = np.repeat(size > 1, size)
    return np.concatenate([one_k, k[at]]), np.concatenate([one_c, c[at]]), k[multi], c[multi], hub[multi]


def _tiler(bands: Bands, k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.steady_memory()
        keys, classes, held, kind, turn = [], [], 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, classes, held
            if not held:
                return
            send_k, send_c, tk, tc, th = _group(np.concatenate(keys), np.concatenate(classes))
            keys, classes, held = [], [], 0
            by = np.argsort(send_k)
            send_k, send_c = send_k[by], send_c[by]
            edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
            cut, tcut = np.searchsorted(send_k, edges), np.searchsorted(tk, edges)
            rows, local = [], []
            for s, m in zip(np.split(np.stack([send_k.view(np.int64), send_c]), cut, 1), np.split(np.stack([tk.view(np.int64), tc, th]), tcut, 1), strict=True):
                rows.append(s.tobytes())
                local.append(m.tobytes())
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n), pa.int32()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(rows, pa.binary()), pa.array(local, pa.binary())],
                ["bucket", "id", "n", "cls", "bits", "sent", "near"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                hs, ds, n = sets_of(*tx.buffers(part.column(1)), k)
                cls = classes_of(hs, ds, n)
                key, owner = tile_keys(hs, ds, n, bands)
                keys.append(key)
                classes.append(cls[owner])
                held += len(key)
                turn += 1
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.arange(rows) + turn) % buckets, pa.int32()), part.column(0), pa.array(n.astype(np.int64)), pa.array(cls), _bitmaps(hs, ds, n), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary())],
                    ["bucket", "id", "n", "cls", "bits", "sent", "near"],
                )
                if held >= FLUSH_ROWS:
                    yield from flush()
        yield from flush()

    return run


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as they come; tiles of several classes, from within a batch and across batches."""
    tx.steady_memory()
    sent, kind = [], None

    def tiles(k: np.ndarray, c: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
        n = len(k)
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(c), pa.nulls(n, pa.binary()), pa.array(k), pa.array(hub)], ["id", "n", "cls", "bits", "key", "hub"])

    for batch in batches:
        kind = batch.schema.field("id").type
        payload = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        docs = batch.filter(pa.array(~payload))
        if docs.num_rows:
            none = pa.nulls(docs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([docs.column(1), docs.column(2), docs.column(3), docs.column(4), none, none], ["id", "n", "cls", "bits", "key", "hub"])
        rest = batch.filter(pa.array(payload))
        for i in range(rest.num_rows):
            sent.append(np.frombuffer(rest.column(5)[i].as_py(), np.int64).reshape(2, -1))
            near = np.frombuffer(rest.column(6)[i].as_py(), np.int64).reshape(3, -1)
            if near.shape[1]:
                yield tiles(*near)
    if sent:
        both = np.concatenate(sent, 1)
        _, _, k, c, hub = _group(both[0].copy().view(np.uint64), both[1])
        for a in range(0, len(k), 1 << 20):
            yield tiles(k[a : a + (1 << 20)].view(np.int64), c[a : a + (1 << 20)], hub[a : a + (1 << 20)])


def _bitmaps(hs: np.ndarray, ds: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bitmaps: 2**j bits, at least twice the set size."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    at = (tx.mix(hs + tx.U64(0xB17)) & (bits[ds] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[ds] + at, minlength=int(base[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((base // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def _differ(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only."""
    n = min(len(a), len(b)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, n), 0) for m in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _bounder(percent: int):
    """Pairs that sizes and bitmaps don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
            fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("bits_a", "bits_b"))
            for i in np.flatnonzero(fits).tolist():
                fits[i] = (100 + percent) * _differ(x[i].as_py(), y[i].as_py()) <= (100 - percent) * int(na[i] + nb[i])
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _namer(k: int):
    """Texts with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(*sets_of(*tx.buffers(part.column(0)), k))), part.column(0)], ["cls", "text"])

    return run


def _verifier(k: int, percent: int):
    """Rows by hub, the hub's own first: the members whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.steady_memory()
        hub, of = None, None
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                b, a, first = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("b", "a", "first"))
                hs, ds, n = sets_of(*tx.buffers(part.column(part.schema.get_field_index("text"))), k)
                edge = np.concatenate([[0], np.cumsum(n)])
                linked = []
                for i in range(part.num_rows):
                    own = hs[edge[i] : edge[i + 1]]
                    if first[i] == 0:
                        hub, of = b[i], np.sort(own)
                        continue
                    if hub != b[i] or not len(of) or not len(own):
                        continue
                    place = np.searchsorted(of, own)
                    place[place == len(of)] = 0
                    both = int(np.count_nonzero(of[place] == own))
                    if 100 * both >= percent * (len(of) + len(own) - both):
                        linked.append(i)
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    return run


def _crosser(percent: int, nearest: bool):
    """Pairs of different components in a cell that the bitmaps don't exclude; or each set's nearest one."""

    def pairs(rows: list[tuple]) -> tuple[list, list]:
        cls = np.array([r[0] for r in rows])
        by = np.unique(cls, return_index=True)[1]
        by = by[np.argsort(np.array([rows[i][2] for i in by]), kind="stable")]
        rows, cls = [rows[i] for i in by], cls[by]
        comp, n, block = (np.array([r[j] for r in rows]) for j in (1, 2, 4))
        least = min(len(r[3]) for r in rows)
        maps = np.zeros((len(rows), least // 8), np.uint64)
        for i, r in enumerate(rows):
            maps[i] = np.bitwise_xor.reduce(np.frombuffer(r[3], np.uint64).reshape(-1, least // 8), 0)
        apart = len(set(block.tolist())) > 1
        left, right = [], []
        for i in range(len(rows)):
            least_n = np.searchsorted(n, -(-n[i] * percent // 100)) if nearest else i + 1  # in order of size
            j = np.arange(least_n, np.searchsorted(n, n[i] * 100 // percent, "right"))
            j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) if apart else True)]
            if len(j):
                differ = np.bitwise_count(maps[j] ^ maps[i]).sum(1).astype(np.int64)
                ok = (100 + percent) * differ <= (100 - percent) * (n[j] + n[i])
                j, differ = j[ok], differ[ok]
                if nearest and len(j):
                    j = j[[np.lexsort((cls[j], differ / (n[j] + n[i])))[0]]]
                left += [cls[i]] * len(j)
                right += cls[j].tolist()
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.steady_memory()
        cell, rows, a, b = None, [], [], []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "lo", "hi", "cls", "comp", "n", "bits", "block")]
            for key, lo, hi, *row in zip(*cols, strict=True):
                if (key, lo, hi) != cell:
                    if rows:
                        x, y = pairs(rows)
                        a += x
                        b += y
                    cell, rows = (key, lo, hi), []
                rows.append(tuple(row))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if rows:
            x, y = pairs(rows)
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't exclude; hubs b with many members are split."""
    side = {c: sets.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"}
    members = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    both = hot.lookup(pairs, side["b"].join(members, "b"), "b", least=HUB_MEMBERS).join(side["a"], "a")
    return both.mapInArrow(_bounder(percent), "a long, b long")


def _texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(cls, text): one text for each class of the pairs."""
    named = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = scratch.table(sets.join(named, "cls", "left_semi").select("i").distinct())
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    some = docs.join(side, F.col("id").eqNullSafe(F.col("i")), "left_semi").select("text")
    return scratch.table(some.mapInArrow(_namer(k), "cls long, text string").dropDuplicates(["cls"]))


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """The similar ones of distinct pairs (a, b); hubs b with many members are split."""
    texts = _texts(docs, sets, pairs, k)
    size = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    size = scratch.table(size.withColumn("cells", F.ceil(F.col("size") / HUB_MEMBERS).cast("int")))
    own = texts.select(F.col("cls").alias("c"), "text")
    members = hot.lookup(pairs, size, "b", least=HUB_MEMBERS).select("b", "a", F.pmod("a", "cells").cast("int").alias("cell"))
    members = members.join(own, F.col("a") == F.col("c")).select("b", "cell", F.lit(1).alias("first"), "a", "text")
    hubs = size.join(own, F.col("b") == F.col("c")).select("b", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("first"), F.col("b").alias("a"), "text")
    rows = members.union(hubs).repartition(n, "b", "cell").sortWithinPartitions("b", "cell", "first")
    return rows.mapInArrow(_verifier(k, percent), "a long, b long")


def _across(tiles: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, n: int, nearest: bool) -> DataFrame:
    """Distinct pairs (a < b) of tiles whose sets are in several components; large tiles are split into cells.

    The round of nearest sets looks at one tile in ``NEAREST_TILES``; it only
    spares the round of all pairs work.
    """
    if nearest:
        tiles = tiles.where(F.pmod("key", F.lit(NEAREST_TILES)) == 0)
    placed = scratch.table(tiles.join(comp, F.col("cls") == F.col("v"), "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp")))
    torn = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    torn = scratch.table(torn.select("key", "size", F.ceil(F.col("size") / CELL).cast("int").alias("cells")))
    left = hot.lookup(placed, torn, "key", least=CELL).withColumn("block", F.pmod(F.xxhash64("cls"), "cells").cast("int"))
    left = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    left = left.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "cls", "comp", "block")
    left = left.join(sets.select("cls", "n", "bits"), "cls").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = left.mapInArrow(_crosser(percent, nearest), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """id, n (shingles), least (id of the component) and cls of every document."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    bands = Bands(percent)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = scratch.partitions(spark, docs)
    kind = thin.schema[0].dataType.simpleString()
    rows = thin.mapInArrow(_tiler(bands, shingle, 2 * n), f"bucket int, id {kind}, n long, cls long, bits binary, sent binary, near binary")
    rows = scratch.table(rows.repartition(n, "bucket").mapInArrow(_joiner, f"id {kind}, n long, cls long, bits binary, key long, hub long"))
    who = rows.where("key is null").select("id", "n", "cls", "bits")
    tiles = rows.where("key is not null").select("key", "cls", "hub")
    sets = scratch.table(who.join(tiles.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("id").alias("i")))

    stars = scratch.table(tiles.where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct())
    stars = scratch.table(_bounded(stars, sets, percent))
    links = scratch.table(_verify(stars, thin, sets, shingle, percent, n))
    comp = scratch.table(components.components(links))

    # Tiles that the links leave in several components.
    placed = scratch.table(tiles.select("key", "cls").union(tiles.select("key", F.col("hub").alias("cls"))).distinct())
    seen = stars.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    for nearest in (True, False):
        across = scratch.table(_across(placed, comp, sets, percent, n, nearest).join(seen, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"))
        if not across.isEmpty():
            seen = seen.union(across.select(F.col("a").alias("x"), F.col("b").alias("y")))
            links = links.union(scratch.table(_verify(across, thin, sets, shingle, percent, n)))
            comp = scratch.table(components.components(links))

    # The least id of each class, of each component, and back to classes and rows.
    some = who.where("n > 0")
    classes = scratch.table(some.groupBy("cls").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("size")))
    linked = scratch.table(classes.join(comp, F.col("cls") == F.col("v")).select("cls", "own", "comp"))
    least = linked.groupBy("comp").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("size"))
    of = classes.join(hot.lookup(linked, least, "comp").select("cls", "comp", "least"), "cls", "left")
    of = scratch.table(of.select("cls", "size", F.when(F.col("comp").isNull(), F.col("own")).otherwise(F.col("least")).alias("least")))
    out = hot.lookup(some, of, "cls").select("id", "n", "least", "cls")
    return out.union(who.where("n = 0").select("id", "n", F.col("id").alias("least"), "cls"))


def group_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id (least id of the component) of every document."""
    found = _grouped(docs, id_col, text_col, shingle, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document of least id.

    Rows of one id are told apart by the classes of their texts: only those go
    whose own component has a lesser id.  Repeated rows of one id and text are
    kept once; rows without an id are kept, once for each text.
    """
    found = scratch.table(_grouped(docs, id_col, text_col, shingle, percent).select(F.col("id").alias("_gf_id"), F.col("least").alias("_gf_least"), F.col("cls").alias("_gf_cls")))
    gone = found.where("_gf_id <> _gf_least")
    kept = found.where("_gf_id is null or _gf_id = _gf_least")
    copies = scratch.table(gone.select("_gf_id").distinct())
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    left = docs.join(side, docs[id_col] == copies["_gf_id"], "left_anti")
    mixed = scratch.table(kept.select("_gf_id").join(side, "_gf_id", "left_semi").distinct())  # ids with rows of both kinds
    n = mixed.count()
    if n:
        side = F.broadcast(mixed) if n <= BROADCAST_IDS else mixed
        rows = docs.join(side, docs[id_col] == mixed["_gf_id"], "left_semi").withColumn("_gf_text", F.coalesce(F.col(text_col), F.lit("")))
        classes = rows.select("_gf_text").distinct().mapInArrow(_namer(shingle), "cls long, text string").select(F.col("cls").alias("_gf_cls"), F.col("text").alias("_gf_text"))
        rows = rows.join(scratch.table(classes), "_gf_text")
        dropped = gone.join(side, "_gf_id", "left_semi").select("_gf_id", F.col("_gf_cls").alias("_gf_of")).distinct()
        rows = rows.join(dropped, (F.col(id_col) == F.col("_gf_id")) & (F.col("_gf_cls") == F.col("_gf_of")), "left_anti")
        left = left.union(rows.select(*docs.columns))
    if kept.count() > kept.where("_gf_id is not null").select("_gf_id").distinct().count():  # repeated ids, or none
        left = left.withColumn("_gf_text", F.xxhash64(text_col)).dropDuplicates([id_col, "_gf_text"]).drop("_gf_text")
    return left


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT e.y, r.m FROM r JOIN e ON r.v = e.x WHERE r.m < e.y)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(m) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
"""
