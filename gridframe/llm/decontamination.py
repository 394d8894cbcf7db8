"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of consecutive words (a shorter item is one window).
A window must be contained whole, so of its shingles, ordered by rarity over
the whole corpus, the rarest one alone is its necessary prefix; a window with a
shingle that the corpus lacks can't occur and goes.  One pass over the documents
counts the shingles that a filter of bits lets through, a second one sends on
the occurrences of prefixes, each with the words around it.  These are joined to
the table of prefixes: the place of the shingle in the window bounds where the
window would start, within the document, and the words are compared.

Neither items nor windows come to the driver; the filter of bits does, its size
is bounded, and a fuller filter only lets more occurrences through to the join.
Equal texts are one text in the join.

Defined results: null text has no words; benchmark rows whose text or id is
null, or without words, are left out; rows of one item id count as one item;
documents keep their repeated rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as tx

WINDOW, SHINGLE = 10, 3
#: bytes of text handled at a time by a worker, and distinct shingles that it counts before it sends them on
CHUNK_BYTES, HELD = 1 << 20, 500_000
#: rows (prefixes, or texts with hits) up to which a side is broadcast; shuffled joins beyond
BROADCAST_ROWS = 100_000
#: least and greatest size of a filter, as powers of two, and bits for each shingle
FILTER_BITS, ROOM = (22, 26), 16
#: fixed values: characters of words before A-Z are lower case, the most frequent first
_WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"


def _tokens(part: pa.RecordBatch, column: str):
    raw, offs = tx.buffers(part.column(part.schema.get_field_index(column)))
    raw = tx.LOWER[raw]
    starts, ends, bounds = tx.words(raw, offs, tx.ALNUM)
    return raw, starts, ends, bounds, tx.span_hash(tx.prefix_hash(raw), starts, ends)


def _cutter(window: int, shingle: int):
    """Items to windows: item, words (by a space), n, k, the hashes of its shingles of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                raw, starts, ends, bounds, h = _tokens(part, "text")
                low, items = raw.tobytes(), part.column(part.schema.get_field_index("item")).to_pylist()
                rows: list[tuple] = []
                for d, item in enumerate(items):
                    a, b = int(bounds[d]), int(bounds[d + 1])
                    n = min(b - a, window)
                    if not n:
                        continue
                    k = min(shingle, n)
                    hs = tx.shingles(h[a:b], k).view(np.int64).tolist()
                    words = [low[x:y].decode() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    rows += [(item, " ".join(words[i : i + n]), n, k, hs[i : i + n - k + 1]) for i in range(b - a - n + 1)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["item", "words", "n", "k", "hashes"])

    return run


def _filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """(bits by the leading bits of a hash, how many those are) of distinct hashes (sh)."""
    n = max(keys.count(), 1)
    power = min(max(int(np.ceil(np.log2(ROOM * n))), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.shiftrightunsigned("sh", 64 - power)
    words = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out, power


def _passed(bits: np.ndarray, power: int, hs: np.ndarray) -> np.ndarray:
    slot = hs >> tx.U64(64 - power)
    return (bits[(slot >> tx.U64(6)).astype(np.int64)] >> (slot & tx.U64(63)) & tx.U64(1)).astype(bool)


def _counter(bits: np.ndarray, power: int, sizes: Sequence[int]):
    """Counts of the shingles that pass, of each worker's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in sizes}

        def flush(k: int) -> pa.RecordBatch:
            values, at = np.unique(np.concatenate([v for v, _ in held[k]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in held[k]])).astype(np.int64)
            held[k] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], ["k", "sh", "n"])

        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                _, _, _, bounds, h = _tokens(part, "text")
                left = bounds[1:][tx.repeat_index(bounds)] - np.arange(len(h))
                for k in sizes:
                    hs = tx.shingles(h, k)
                    hs = hs[_passed(bits, power, hs) & (left[: len(hs)] >= k)]
                    if len(hs):
                        held[k].append(np.unique(hs, return_counts=True))
                    if sum(len(v) for v, _ in held[k]) > HELD:
                        yield flush(k)
        for k in sizes:
            if held[k]:
                yield flush(k)

    return run


def _prober(bits: np.ndarray, power: int, sizes: Sequence[int], window: int):
    """Occurrences of prefixes: key, k, sh, the word at which it starts, the words around it and which of them it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                raw, starts, ends, bounds, h = _tokens(part, "text")
                low, keys = raw.tobytes(), part.column(part.schema.get_field_index("key"))
                doc = tx.repeat_index(bounds)
                left = bounds[1:][doc] - np.arange(len(h))
                for k in sizes:
                    hs = tx.shingles(h, k)
                    at = np.flatnonzero(_passed(bits, power, hs) & (left[: len(hs)] >= k))
                    for i in range(0, len(at), 50_000):
                        p = at[i : i + 50_000]
                        d = doc[p]
                        a, b = np.maximum(bounds[d], p - (window - k)), np.minimum(bounds[d + 1], p + window)
                        around = [b" ".join([low[starts[j] : ends[j]] for j in range(x, y)]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(d)), pa.array(np.full(len(p), k, np.int32)), pa.array(hs[p].view(np.int64)), pa.array(p - bounds[d]), pa.array(around, pa.binary()).cast(pa.string()), pa.array((p - a).astype(np.int32))],
                            ["key", "k", "sh", "at", "around", "before"],
                        )

    return run


def prefixes(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """k, sh, off, words, n of each window that may occur: the shingle that is rarest over ``texts`` and its place."""
    each = windows.select("words", "n", "k", F.posexplode("hashes").alias("off", "sh"))
    keys = scratch.table(each.select("k", "sh").distinct())
    bits, power = _filter(keys.select("sh").distinct())
    sizes = sorted(r.k for r in keys.select("k").distinct().collect())
    seen = texts.mapInArrow(_counter(bits, power, sizes), "k int, sh long, c long").groupBy("k", "sh").agg(F.sum("c").alias("c"))
    counts = scratch.table(seen.join(keys, ["k", "sh"], "left_semi"))
    ranked = each.join(counts, ["k", "sh"], "left").groupBy("words", "n", "k").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "sh", "off")).alias("p"))
    return ranked.where("p.c > 0").select("k", "p.sh", "p.off", "words", "n")


def _hits(docs: DataFrame, first: DataFrame, window: int, broadcast_rows: int) -> DataFrame:
    """key, start, end, words: the windows in the texts (key, text), each place once."""
    bits, power = _filter(first.select("sh").distinct())
    sizes = sorted(r.k for r in first.select("k").distinct().collect())
    found = docs.mapInArrow(_prober(bits, power, sizes, window), "key string, k int, sh long, at long, around string, before int")
    side = F.broadcast(first) if first.count() <= broadcast_rows else first
    both = found.join(side, ["k", "sh"]).where("before >= off")
    there = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("off") + 1, F.col("n")), " ")
    start = F.col("at") - F.col("off")
    return both.where(there == F.col("words")).select("key", start.alias("start"), (start + F.col("n")).alias("end"), "words").distinct()


def _merged(hits: DataFrame) -> DataFrame:
    """key, hits: the union of a text's spans as a flat list."""
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    spans = hits.select("key", "start", "end").distinct().withColumn("new", apart).withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy("key", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    listed = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("l"))
    return listed.select("key", F.flatten(F.transform("l", lambda x: F.array(x["s"], x["e"]))).alias("hits"))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    keep: tuple[str, ...] = ("doc_id",),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``keep`` columns (as ``k0``, ``k1`` ..), ``text``, ``n_words``, ``hits`` (flat word spans) and ``items``."""
    scratch.small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    owned = scratch.table(items.mapInArrow(_cutter(window, shingle), "item string, words string, n int, k int, hashes array<bigint>"))
    text = F.col(text_col)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text.alias("text"), F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = {"hits": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")}
    windows = owned.groupBy("words", "n", "k").agg(F.first("hashes").alias("hashes"))
    first = scratch.table(prefixes(windows, docs.where(text.isNotNull()).select(text.alias("text")))) if not owned.isEmpty() else None
    if first is None or first.isEmpty():
        return frame.select("*", *[c.alias(n) for n, c in none.items()])
    hits = scratch.table(_hits(docs.where(text.isNotNull()).select(F.md5(text).alias("key"), text.alias("text")), first, window, broadcast_rows))
    of = hits.select("key", "words").distinct().join(owned.select("words", "item").distinct(), "words").select("key", "item").distinct()
    found = scratch.table(_merged(hits).join(of.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")), "key"))
    side = F.broadcast(found) if found.count() <= broadcast_rows else found
    frame = frame.join(side, F.md5("text") == F.col("key"), "left").drop("key")
    return frame.withColumns({n: F.coalesce(n, c) for n, c in none.items()})


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items, contaminated."""
    found = find_hits(docs, benchmark, keep=(id_col,), **options)
    covered = F.aggregate(F.sequence(F.lit(0), F.floor(F.size("hits") / 2).cast("int") - 1), F.lit(0).cast("long"), lambda a, i: a + F.element_at("hits", 2 * i + 2) - F.element_at("hits", 2 * i + 1))
    n_hit = F.when(F.size("hits") > 0, covered).otherwise(F.lit(0).cast("long"))
    return found.select(F.col("k0").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (n_hit > 0).alias("contaminated"))


def item_digest(items):
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


_WORDS = r"""regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="text")} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
