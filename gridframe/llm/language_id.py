"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table serves all languages: slot s holds a bit mask of the languages that
set it, in as many words as 64 bits each take.  The AND of an n-gram's slots is the mask of all languages that contain
it.  Per text and language the set bits are counted, corrected for the rate at
which the filter answers falsely, and the highest count decides.

Learning takes a bounded sample: of each language the ``train_docs`` documents
of least id hash, out of those whose fold allows it, as whole texts, as far as
``train_bytes`` go (the first text always).  Every labelled language is learned;
what is collected grows with their number.  N-grams seen once in the sample are
left out, but not where it has no more than two documents or would leave none.
The filter has at least 16 slots for each n-gram of the language that has most,
so a language answers falsely for less than one n-gram in 100.  Scoring covers
every whole text.

Defined results: null text or text without a letter (Unicode category L) is
``und`` with score 0; a text whose n-grams no filter knows gets the most
frequent language, score 0; ties go to the language with more labelled rows to
learn from, then the first by code point; nothing learned gives ``und``;
repeated rows are each scored, and one id is learned once for each language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sample, scratch
from . import text as tx

TRAIN_DOCS, TRAIN_BYTES, WORD, NGRAM, LEAST = 400, 4 << 20, 64, 5, 2
#: least size of the filter, as a power of two, and slots for each n-gram
SLOT_BITS, ROOM = 20, 16
#: odd multipliers, one for each slot of an n-gram
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CHUNK_BYTES = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.zeros(256, np.int64)
_ASCII[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = 1
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = list(range(0x61, 0x7B)) + list(range(0x80, 0x100))
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _grams(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the n-grams over letters, other runs taken as one space."""
    size = len(offs) - 1
    spread = np.full(len(raw) + 2 * size, 0x20, np.uint8)
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(size) + 1, np.diff(offs))
    spread[at] = _FOLD[raw]
    space = spread == 0x20
    stay = np.ones(len(spread), bool)
    stay[1:] = ~(space[1:] & space[:-1])
    begins = offs[:-1] + 2 * np.arange(size)
    stay[begins] = True
    seq = spread[stay].astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(stay)])[np.append(begins, len(spread))]
    count = max(len(seq) - n + 1, 0)
    g = np.zeros(count, np.uint64)
    for j in range(n):
        g |= seq[j : j + count] << tx.U64(8 * j)
    doc = tx.repeat_index(bounds)
    inside = doc[:count] == doc[n - 1 : n - 1 + count] if count else np.zeros(0, bool)
    return tx.mix(g[inside]), doc[:count][inside]


class Model:
    """Languages in ``order`` (by default that of their samples' sizes), the sliced filter and its false rates."""

    def __init__(self, samples: dict[str, list[str]], ngram: int = NGRAM, order: Sequence[str] | None = None):
        self.names = list(order) if order is not None else sorted(samples, key=lambda k: (-len(samples[k]), k))
        self.ngram = ngram
        grams = [self._learned(samples[name]) for name in self.names]
        most = max(map(len, grams), default=0)
        self.bits = max(SLOT_BITS, int(np.ceil(np.log2(max(ROOM * most, 1)))))
        kind = np.uint8 if len(self.names) <= 8 else np.uint64
        self.tables = [np.zeros(1 << self.bits, kind) for _ in range(0, len(self.names), WORD)]
        load = np.zeros(len(self.names))
        for i, values in enumerate(grams):
            table = self.tables[i // WORD]
            for s in self._slots(values):
                table[s] |= kind(1 << i % WORD)
            load[i] = np.count_nonzero(table & kind(1 << i % WORD)) / len(table)
        self.false = load ** len(HASHES)

    def _learned(self, texts: list[str]) -> np.ndarray:
        raws = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        values, counts = np.unique(_grams(np.frombuffer(b"".join(raws), np.uint8), offs, self.ngram)[0], return_counts=True)
        often = values[counts >= LEAST]
        return often if len(raws) > LEAST and len(often) else values

    def _slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for m in HASHES:
            yield ((h * tx.U64(m)) >> tx.U64(64 - self.bits)).astype(np.int64)

    def score(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of the corrected counts, part of the n-grams it knows) of each text."""
        n = len(offs) - 1
        h, doc = _grams(raw, offs, self.ngram)
        total = np.bincount(doc, minlength=n).astype(float)
        edge = np.searchsorted(doc, np.arange(n + 1))
        right = np.zeros((n, len(self.names)))
        for i in range(len(self.names)):
            if i % WORD == 0:
                table = self.tables[i // WORD]
                mask = np.full(len(h), ~table.dtype.type(0), table.dtype)
                for s in self._slots(h):
                    mask &= table[s]
            hits = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i % WORD)) & mask.dtype.type(1), dtype=np.int64)])
            got = (hits[edge[1:]] - hits[edge[:-1]]).astype(float)
            right[:, i] = np.maximum(got - total * self.false[i], 0) / (1 - self.false[i])
        best = right.argmax(1)
        sums = right.sum(1)
        top = right[np.arange(n), best]
        return best, np.where(sums > 0, top / np.where(sums > 0, sums, 1), 0.0), np.where(total > 0, top / np.maximum(total, 1), 0.0)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on the bounded sample; ``allowed`` is a condition on the rows of ``docs``."""
    text = F.col(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))  # a null id: its text
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).alias("g"), name.alias("i"), text.alias("t"))
    ids = rows.select("g", "i")
    counts = {r.g: r["count"] for r in ids.groupBy("g").count().collect()}
    names = sorted(counts, key=lambda k: (-counts[k], k))
    if not names:
        return Model({})
    # rows below a level of the hash that leaves about twice as many as are wanted, not a ranking of each language
    levels = docs.sparkSession.createDataFrame([(g, min(1.0, (2 * train_docs + 50) / counts[g])) for g in names], f"g {ids.schema['g'].dataType.simpleString()}, level double")
    low = ids.withColumn("h", F.xxhash64("i")).join(F.broadcast(levels), "g").where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.col("level"))
    near: dict = {}
    for r in low.select("g", "h", "i").distinct().collect():
        near.setdefault(r.g, []).append((r.h % (1 << 64), r.i))
    wanted = [(g, i) for g in names for _, i in sorted(near.get(g, ()), key=lambda x: (x[0], str(x[1])))[:train_docs]]
    samples: dict[str, list[str]] = {g: [] for g in names}
    for g, _, t in sample.whole_texts(rows, wanted, train_bytes):
        samples[g].append(t)
    return Model(samples, order=names)


def _run(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.names, "und"], object)
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                i = part.schema.get_field_index("text")
                raw, offs = tx.buffers(part.column(i))
                sums = np.concatenate([[0], np.cumsum(_ASCII[raw])])
                lettered = sums[offs[1:]] > sums[offs[:-1]]
                for d in np.flatnonzero(~lettered & (offs[1:] > offs[:-1])).tolist():
                    lettered[d] = bool(_LETTER.search(part.column(i)[d].as_py() or ""))
                if model.names:
                    best, score, known = model.score(raw, offs)
                else:
                    best, score, known, lettered = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                best = np.where(lettered, best, len(model.names))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(j) for j in range(part.num_columns)], pa.array(names[best].tolist(), pa.string()), pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0)), pa.array(np.where(lettered, known, 0.0))],
                    [*part.schema.names, "lang_pred", "score", "known"],
                )

    return run


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (as ``k0`` ..), ``text``, ``lang_pred``, ``score`` and ``known``."""
    scratch.small_batches(docs.sparkSession)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema], "lang_pred string, score double, known double"])
    return frame.mapInArrow(_run(model), schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, **options) -> DataFrame:
    """id, held_out, lang_pred and score of every document."""
    usable = F.coalesce(fold(F.col(id_col), folds) != held, F.lit(False))
    model = learn(docs, usable, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predict(docs, model, text_col=text_col, keep=(id_col,)).withColumn("held_out", F.coalesce(fold(F.col("k0"), folds) == held, F.lit(False))).select(F.col("k0").alias(id_col), "held_out", "lang_pred", "score")
