"""Exact substring removal with suffix arrays.

A byte is removed when a string of ``length`` bytes covers it that also starts
in a document of smaller id.

Equal strings are brought together by content: of each string's k-grams the
one of least hash is its anchor, and the strings of one anchor, a run of
neighbours, travel as one segment to the shard that owns the anchor.  In a
shard, segments whose anchor only one document has cannot repeat and go no
further; the others, equal ones told once with their least id, form a text
whose suffix array is built by Larsson-Sadakane refinement.  Common prefixes
by Kasai's rule delimit the groups of equal strings, and each group's least id
decides.  An anchor with more text than a shard takes is split over several
suffix arrays, whose groups are merged by binary search.

Equal segments within a batch are settled where they are read: only the
occurrence of least id travels, so that a passage in very many documents
reaches a shard once for each batch.  Texts travel once more, compressed, to
meet what is to be removed from them.

Defined results: null text is empty; a text shorter than ``length`` keeps all;
rows of one id are one document, so they don't remove from one another, and
each is cut by its own text; a null id comes last; overlapping removals are
one span.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, suffix
from . import text as tx

LENGTH, GRAM = 50, 16
CHUNK_BYTES, FLUSH_BYTES, SHARD_BYTES, LEVEL = 1 << 20, 10 << 20, 1 << 20, 5
NO_ID = (1 << 63) - 1
_FAR = np.int64(1 << 40)


def _gram_hash(raw: np.ndarray, at: np.ndarray | None = None, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on, or from positions ``at`` on."""
    n = len(raw)
    data = np.concatenate([raw, np.zeros(gram + 8, np.uint8)])
    word = np.ndarray((n + gram,), "<u8", data, strides=(1,))
    h = np.zeros(n if at is None else len(at), np.uint64)
    for j in range(0, gram, 8):
        part = word[j : j + n] if at is None else word[at + j]
        h = tx.mix(h + part * tx.U64(0x9E3779B97F4A7C15 + 2 * j))
    return h


def segments(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of the texts: first and end byte, anchor hash and place, text, content hash."""
    n = len(raw)
    h = _gram_hash(raw, gram=gram)
    least = (h & tx.U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    want, have = length - gram + 1, 1
    while 2 * have <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < want:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    end = np.repeat(offs[1:], np.diff(offs))
    start = np.flatnonzero(np.arange(n) + length <= end)
    anchor = (least[start] & tx.U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    first = start[at]
    last = start[np.append(at[1:], len(start)) - 1] if len(at) else first
    anchor = anchor[at]
    return {"first": first, "end": last + length, "anchor": h[anchor], "place": anchor - first, "doc": np.searchsorted(offs, first, "right") - 1, "content": tx.span_hash(tx.prefix_hash(raw), first, last + length)}


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each owner (a small number), in order."""
    if not len(owner):
        return owner, start, end
    by = np.lexsort((start, owner))
    owner, start, end = owner[by], start[by], end[by]
    reach = np.maximum.accumulate(owner * _FAR + end)
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] * _FAR + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return owner[at], start[at], reach[np.append(at[1:], len(owner)) - 1] - owner[at] * _FAR


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 .. (count[0] of them), start[1] .."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Shard:
    """Suffix array over distinct segments; the least id of each group of equal strings."""

    def __init__(self, content: np.ndarray, size: np.ndarray, least: np.ndarray, length: int):
        self.content, self.length = content, length
        n = len(content)
        sa = suffix.suffix_array(suffix.byte_keys(content), 8, length)
        common = suffix.common_prefixes(content, sa, length)
        owner = np.repeat(np.arange(len(size)), size)
        whole = np.cumsum(size)[owner[sa]] - sa >= length
        group = np.cumsum(common < length)[whole]
        self.pos = sa[whole].astype(np.int32)
        new = np.ones(len(self.pos), bool)
        new[1:] = group[1:] != group[:-1]
        self.at = np.flatnonzero(new)
        self.group = (np.cumsum(new) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(least[owner[self.pos]], self.at)
        self.total = n

    def strings(self) -> np.ndarray:
        """The groups' strings, in order."""
        first = self.pos[self.at]
        rows = np.lib.stride_tricks.sliding_window_view(self.content, self.length)[first]
        return np.ascontiguousarray(rows).view(f"S{self.length}").ravel()

    def by_position(self) -> np.ndarray:
        out = np.full(self.total, NO_ID, np.int64)
        out[self.pos] = self.least[self.group]
        return out


def merge_shards(shards: list[Shard]) -> None:
    """Give each group the least id over all shards, finding it there by binary search."""
    keys = [s.strings() for s in shards]
    for i, a in enumerate(shards):
        for j, b in enumerate(shards):
            if i != j:
                at = np.minimum(np.searchsorted(keys[j], keys[i]), len(keys[j]) - 1)
                same = keys[j][at] == keys[i]
                a.least = np.where(same, np.minimum(a.least, b.least[at]), a.least)


def decide(content: np.ndarray, off: np.ndarray, size: np.ndarray, ids: np.ndarray, anchor: np.ndarray, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of what to remove, relative to the segment."""
    by = np.argsort(anchor)
    a, d = anchor[by], ids[by]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(new)
    several = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    by = by[np.repeat(several, np.diff(np.append(at, len(a))))]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(by):
        a = anchor[by]
        group = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
        sums = np.bincount(group, size[by]).astype(np.int64)
        # groups to runs of about shard_bytes; a larger group is a run by itself
        run = (np.cumsum(sums) // shard_bytes)[group]
        cuts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        same = _content_hash(content, off[by], size[by])
        for lo, hi in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            out += _decide_run(content, off, size, ids, by[lo:hi], same[lo:hi], length, shard_bytes)
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _content_hash(content: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each segment, for about a MB of segments at a time."""
    out = np.empty(len(off), np.uint64)
    for i in range(0, len(off), 15_000):
        o, n = off[i : i + 15_000], size[i : i + 15_000]
        text = content[_ragged(o, n)]
        end = np.cumsum(n)
        out[i : i + 15_000] = tx.span_hash(tx.prefix_hash(text), end - n, end)
    return out


def _decide_run(content, off, size, ids, rows, same, length, shard_bytes):
    """Decide the segments ``rows``, whose content hashes are ``same``; no anchor is in two runs."""
    by = np.argsort(same)
    new = np.append(True, same[by[1:]] != same[by[:-1]])
    at = np.flatnonzero(new)
    which = np.empty(len(rows), np.int32)  # distinct segment of each row
    which[by] = np.cumsum(new) - 1
    model = rows[by[at]]
    least = np.minimum.reduceat(ids[rows][by], at)
    dsize = size[model]
    part = np.cumsum(dsize) // shard_bytes
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    shards = []
    for lo, hi in zip(cuts, np.append(cuts[1:], len(dsize)), strict=True):
        shards.append(Shard(content[_ragged(off[model[lo:hi]], dsize[lo:hi])], dsize[lo:hi], least[lo:hi], length))
    if len(shards) > 1:
        merge_shards(shards)
    first = np.cumsum(dsize) - dsize
    by_position = np.concatenate([s.by_position() for s in shards])
    shards.clear()
    out = []
    for i in range(0, len(rows), 50_000):
        r, w = rows[i : i + 50_000], which[i : i + 50_000]
        count = dsize[w] - length + 1
        gone = by_position[_ragged(first[w], count)] < np.repeat(ids[r], count)
        rel = _ragged(np.zeros(len(r), np.int64), count)
        begin = np.cumsum(count) - count
        lo = np.minimum.reduceat(np.where(gone, rel, 1 << 30), begin)
        hi = np.maximum.reduceat(np.where(gone, rel, -1), begin)
        hit = hi >= 0  # strings of a segment overlap, so what they cover is one span
        out.append((r[hit], lo[hit], hi[hit] + length))
    return out


def _pieces(off: np.ndarray, size: np.ndarray, rows: int = 100_000) -> list[tuple[int, int, int, int]]:
    """(row, next row, byte, next byte) of consecutive runs of segments."""
    ends = [*range(0, len(off), rows), len(off)]
    return [(i, j, int(off[i]), int(off[j - 1] + size[j - 1])) for i, j in zip(ends[:-1], ends[1:], strict=True) if j > i]


def _doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    values, back = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(str(v).encode()) % n for v in values.tolist()], np.int64)[back]


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([head.tobytes(), *[a.tobytes() for a in arrays]]))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(raw, np.int64, 1 + len(kinds))
    at, out = head.nbytes, []
    for n, k in zip(head[1:].tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at))
        at += n
    return out


_GONE = (np.int64, np.uint32, np.uint32, np.uint32)  # id, digest of the text, start, length


def _pack_gone(ids: np.ndarray, digest: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    by = np.lexsort((start, digest, ids))  # in order they compress better
    return _pack(ids[by], digest[by], start[by].astype(np.uint32), (end - start)[by].astype(np.uint32))


def _unpack_gone(blob: bytes) -> tuple[np.ndarray, ...]:
    ids, digest, start, size = _unpack(blob, *_GONE)
    return ids, digest, start, start + size


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of slices of about ``limit`` bytes."""
    for batch in batches:
        for part in tx.slices(batch, "text", limit):
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            yield ids, *tx.buffers(part.column(1))


def _digests(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint32)


def _cutter(length: int, gram: int, seats: list[int]):
    """Documents to compressed segments for each shard, and removals settled within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.steady_memory()
        held: list[tuple] = []
        size = turn = 0
        n = len(seats)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, turn
            if not held:
                return
            shift = np.cumsum([0, *[len(r) for _, r, _, _ in held]])
            base = np.cumsum([0, *[len(i) for i, _, _, _ in held]])
            raw = np.concatenate([r for _, r, _, _ in held])
            ids = np.concatenate([i for i, _, _, _ in held])
            digest = np.concatenate([_digests(r, o) for _, r, o, _ in held])
            begin = np.concatenate([o[:-1] + s for (_, _, o, _), s in zip(held, shift, strict=False)])
            seg = {k: np.concatenate([x[3][k] for x in held]) for k in ("anchor", "place", "content")}
            first = np.concatenate([x[3]["first"] + s for x, s in zip(held, shift, strict=False)])
            length_ = np.concatenate([x[3]["end"] - x[3]["first"] for x in held])
            doc = np.concatenate([x[3]["doc"] + b for x, b in zip(held, base, strict=False)])
            held, size = [], 0
            by = np.argsort(seg["content"])
            new = np.append(True, seg["content"][by[1:]] != seg["content"][by[:-1]])[: len(by)]
            at = np.flatnonzero(new)
            if len(at):
                low = np.empty(len(by), np.int64)
                low[by] = np.repeat(np.minimum.reduceat(ids[doc[by]], at), np.diff(np.append(at, len(by))))
                settled = ids[doc] > low
            else:
                settled = np.zeros(0, bool)
            own, s, e = merge_spans(doc[settled], (first - begin[doc])[settled], (first - begin[doc] + length_)[settled])
            rows, where = [], []
            gone = [None] * n
            gone[turn % n] = _pack_gone(ids[own], digest[own], s, e) if len(own) else None
            turn += 1
            send = np.flatnonzero(~settled)
            spread = tx.mix(seg["anchor"][send] + tx.U64(1))  # anchors are least hashes, and so mostly small
            shard = ((spread >> tx.U64(32)) * tx.U64(n) >> tx.U64(32)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            send, cut = send[by], np.searchsorted(shard[by], np.arange(n + 1))
            for b in range(n):
                g = send[cut[b] : cut[b + 1]]
                if not len(g) and gone[b] is None:
                    continue
                blob = None
                if len(g):
                    some, local = np.unique(doc[g], return_inverse=True)
                    blob = _pack(ids[some], digest[some], local.astype(np.uint32), (first - begin[doc])[g].astype(np.uint32), length_[g].astype(np.uint8), seg["place"][g].astype(np.uint8), raw[_ragged(first[g], length_[g])])
                rows.append(blob)
                where.append(b)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([seats[b] for b in where], pa.int32()), pa.array(rows, pa.binary()), pa.array([gone[b] for b in where], pa.binary())], ["bucket", "sent", "gone"])

        for ids, raw, offs in _texts(batches, CHUNK_BYTES):
            held.append((ids, raw, offs, segments(raw, offs, length, gram)))
            size += len(raw)
            if size >= FLUSH_BYTES:
                yield from flush()
        yield from flush()

    return run


_SEGMENT = (np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8)


def _sharder(length: int, gram: int, seats: list[int]):
    """Segments of a shard to packed removals by group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.steady_memory()
        got: list[tuple] = []
        parts: list[tuple] = []
        for batch in batches:
            for sent, gone in zip(batch.column(1), batch.column(2), strict=True):
                if gone.is_valid:
                    parts.append(_unpack_gone(gone.as_py()))
                if sent.is_valid:
                    ids, digest, local, start, size, place, content = _unpack(sent.as_py(), *_SEGMENT)
                    got.append((ids[local], digest[local], start, size, place, content))
        if got:
            ids, digest, start, size, place = (np.concatenate([g[i] for g in got]) for i in range(5))
            content = np.empty(sum(len(g[5]) for g in got), np.uint8)
            at = len(content)
            while got:  # from the last, so that each block is freed once copied
                block = got.pop()[5]
                content[at - len(block) : at] = block
                at -= len(block)
            size = size.astype(np.int64)
            off = np.cumsum(size) - size
            anchor = np.concatenate([_gram_hash(content[a : b + gram], off[i:j] + place[i:j] - a, gram) for i, j, a, b in _pieces(off, size)])
            seg, lo, hi = decide(content, off, size, ids, anchor, length)
            parts.append((ids[seg], digest[seg], (start[seg] + lo).astype(np.uint32), (start[seg] + hi).astype(np.uint32)))
        if not parts:
            return
        ids, digest, start, end = (np.concatenate([p[i] for p in parts]) for i in range(4))
        bucket = _doc_bucket(ids, len(seats))
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(len(seats) + 1))
        rows, where = [], []
        for b in range(len(seats)):
            g = by[cut[b] : cut[b + 1]]
            if len(g):
                rows.append(_pack_gone(ids[g], digest[g], start[g], end[g]))
                where.append(seats[b])
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], ["bucket", "gone", "docs"])

    return run


def _packer(seats: list[int]):
    """Documents to compressed blocks by group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.steady_memory()
        n = len(seats)
        for ids, raw, offs in _texts(batches, 2 * FLUSH_BYTES):
            bucket = _doc_bucket(ids, n)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(n + 1))
            size = np.diff(offs)
            rows, where = [], []
            for b in range(n):
                g = by[cut[b] : cut[b + 1]]
                if len(g):
                    body = np.concatenate([raw[offs[i] : offs[i + 1]] for i in g.tolist()])
                    rows.append(_pack(ids[g], size[g], body))
                    where.append(seats[b])
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array(rows, pa.binary())], ["bucket", "gone", "docs"])

    return run


def _finisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the documents of a group by the removals that came for them."""
    tx.steady_memory()
    blocks, parts = [], []
    for batch in batches:
        for gone, docs in zip(batch.column(1), batch.column(2), strict=True):
            if gone.is_valid:
                parts.append(_unpack_gone(gone.as_py()))
            if docs.is_valid:
                blocks.append(docs.as_py())
    if parts:
        ids, digest, start, end = (np.concatenate([p[i] for p in parts]) for i in range(4))
    else:
        ids, digest, start, end = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    parts.clear()
    by = np.lexsort((digest, ids))
    ids, digest, start, end = ids[by], digest[by], start[by].astype(np.int64), end[by].astype(np.int64)
    new = np.append(True, (ids[1:] != ids[:-1]) | (digest[1:] != digest[:-1]))[: len(ids)]
    owner, start, end = merge_spans(np.cumsum(new) - 1, start, end)
    number = {(i, d): k for k, (i, d) in enumerate(zip(ids[new].tolist(), digest[new].tolist(), strict=True))}
    edge = np.searchsorted(owner, np.arange(len(number) + 1))
    for block in blocks:
        doc, size, body = _unpack(block, np.int64, np.int64, np.uint8)
        offs = np.concatenate([[0], np.cumsum(size)])
        digests = _digests(body, offs)
        removed, spans, kept = [], [], []
        for i, key in enumerate(zip(doc.tolist(), digests.tolist(), strict=True)):
            text = body[offs[i] : offs[i + 1]]
            k = number.get(key)
            if k is None:
                removed.append(0)
                spans.append([])
                kept.append(text.tobytes())
                continue
            s, e = start[edge[k] : edge[k + 1]], end[edge[k] : edge[k + 1]]
            removed.append(int((e - s).sum()))
            spans.append(np.stack([s, e], 1).ravel().tolist())
            starts, ends = np.append(0, e).tolist(), np.append(s, len(text)).tolist()
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(starts, ends, strict=True)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=doc == NO_ID), pa.array(size), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id (long), n_bytes, n_removed, n_spans, spans (flat byte offsets) and kept (binary) of every document."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = scratch.partitions(spark, docs)
    seats = scratch.placement(spark, n)
    cut = thin.mapInArrow(_cutter(length, gram, seats), "bucket int, sent binary, gone binary").repartition(n, "bucket")
    # written, so that the segments' shuffle files go before the texts travel
    gone = scratch.table(cut.mapInArrow(_sharder(length, gram, seats), "bucket int, gone binary, docs binary"))
    texts = thin.mapInArrow(_packer(seats), "bucket int, gone binary, docs binary")
    met = gone.union(texts).repartition(n, "bucket")
    return met.mapInArrow(_finisher, "id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary").withColumnRenamed("id", id_col)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, p, p > lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS new FROM w JOIN m USING (w) WHERE least < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
q AS (SELECT doc_id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS z FROM s),
t AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS kept
    FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
