"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved with learned filters (width 6, stride 2) over
chunks of 256 bytes that overlap by half and cover the whole document.  Each
chunk is max-pooled; the pooled chunks are averaged, and a small dense layer
makes one probability of them.

Learning takes a bounded sample of labelled rows (``train_rows``, half of each
class where there are enough, by least id hash); scoring covers whole texts.
For scoring, embedding and filters are folded into three tables over byte
pairs, so that a convolution is three look-ups.

Defined results: null text counts as empty; an empty text is scored as one chunk
of padding; null labels and ids are never learned from; a row with several
labels takes the highest; without both classes the score is the share of label
1 (0.5 without any label); repeated rows are each scored, and one id is learned
once, with the text of least hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sample, scratch
from . import text as tx

TRAIN_ROWS, TRAIN_BYTES, EPOCHS, SEED = 2000, 32 << 20, 14, 11
WIDTH, HALF = 6, 64  # bytes of a filter; byte pairs in half a chunk
EMBED, FILTERS, HIDDEN = 8, 24, 16
CHUNK_BYTES = 1 << 20


def _layout(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to even length plus one filter; byte pairs and offsets in pairs."""
    lens = np.diff(offs)
    pairs = (lens + 1) // 2 + WIDTH // 2
    at = np.concatenate([[0], np.cumsum(pairs)])
    out = np.zeros(2 * at[-1], np.uint8)
    out[np.arange(len(raw)) + np.repeat(2 * at[:-1] - offs[:-1], lens)] = raw
    return out, at


def _halves(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the half chunks of filter positions of each text."""
    size = np.diff(at) - WIDTH // 2 + 1
    n = -(-size // HALF)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][text] + k * HALF
    return start, np.minimum(start + HALF, at[:-1][text] + size[text]), text


def _chunks(pooled: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring halves make a chunk; a single half is one by itself."""
    pair = np.flatnonzero(text[1:] == text[:-1])
    single = np.bincount(text) == 1
    lone = np.flatnonzero(single[text])
    left, right = np.concatenate([pair, lone]), np.concatenate([pair + 1, lone])
    return left, right


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "E": r.normal(0, 0.5, (256, EMBED)),
            "K": r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
            "c": np.zeros(FILTERS),
            "V": r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)),
            "d": np.zeros(HIDDEN),
            "w": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None
        self.shift = 0.0

    def _head(self, pooled: np.ndarray, text: np.ndarray, n: int):
        left, right = _chunks(pooled, text)
        both = np.maximum(pooled[left], pooled[right])
        act = np.tanh(both + self.p["c"])
        owner = text[left]
        count = np.bincount(owner, minlength=n).astype(np.float32)
        mean = np.zeros((n, FILTERS), np.float32)
        np.add.at(mean, owner, act)
        mean /= count[:, None]
        hid = np.tanh(mean @ self.p["V"] + self.p["d"])
        z = hid @ self.p["w"] + self.p["b"][0]
        return z, (left, right, act, owner, count, mean, hid)

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        step = 0
        for epoch in range(epochs):
            for ids in np.array_split(r.permutation(len(texts)), max(1, len(texts) // batch)):
                raw = np.frombuffer(b"".join(texts[i] for i in ids), np.uint8)
                offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])]).astype(np.int64)
                g = self._gradients(raw, offs, y[ids], weight[ids])
                step += 1
                now = rate * (0.5 if epoch > epochs // 2 else 1.0)
                for k, v in g.items():
                    v = v + np.float32(1e-5) * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def _gradients(self, raw, offs, y, weight) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        bytes_, at = _layout(raw, offs)
        start, end, text = _halves(at)
        emb = p["E"][np.concatenate([bytes_, np.zeros(2 * HALF + WIDTH, np.uint8)])]
        pos = start[:, None] + np.arange(HALF)
        conv = np.zeros((len(bytes_) // 2 + HALF, FILTERS), np.float32)
        for j in range(WIDTH):
            conv += emb[j : j + 2 * len(conv) : 2] @ p["K"][j]
        grid = conv[pos]
        grid[pos >= end[:, None]] = -np.inf
        arg = grid.argmax(1)
        pooled = np.take_along_axis(grid, arg[:, None, :], 1)[:, 0]
        z, (left, right, act, owner, count, mean, hid) = self._head(pooled, text, n)
        dz = (1 / (1 + np.exp(-z)) - y) * weight / n
        g = {"w": hid.T @ dz, "b": np.array([dz.sum()], np.float32)}
        dh = dz[:, None] * p["w"] * (1 - hid**2)
        g["V"], g["d"] = mean.T @ dh, dh.sum(0)
        da = (dh @ p["V"].T / count[:, None])[owner] * (1 - act**2)
        g["c"] = da.sum(0)
        dp = np.zeros_like(pooled)
        first = pooled[left] >= pooled[right]
        np.add.at(dp, left, np.where(first, da, 0))
        np.add.at(dp, right, np.where(first, 0, da))
        place = 2 * (start[:, None] + arg)
        g["K"], g["E"] = np.zeros_like(p["K"]), np.zeros_like(p["E"])
        padded = np.concatenate([bytes_, np.zeros(2 * HALF + WIDTH, np.uint8)])
        for j in range(WIDTH):
            b = padded[place + j]
            for f in range(FILTERS):
                by = np.bincount(b[:, f], dp[:, f], 256).astype(np.float32)
                g["K"][j, :, f] = by @ p["E"]
                g["E"] += by[:, None] * p["K"][j, :, f]
        return g

    def tables(self) -> list[np.ndarray]:
        """Response of each filter to a byte pair (low byte first) at each of its three places."""
        each = [self.p["E"] @ self.p["K"][j] for j in range(WIDTH)]
        return [(each[2 * j][None, :, :] + each[2 * j + 1][:, None, :]).reshape(65536, FILTERS) for j in range(WIDTH // 2)]

    def score(self, raw: np.ndarray, offs: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        n = len(offs) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        bytes_, at = _layout(raw, offs)
        pairs = bytes_.view("<u2").astype(np.int64)
        start, end, text = _halves(at)
        pooled = np.empty((len(start), FILTERS), np.float32)
        step = 256  # half chunks at a time, to stay in cache
        for a in range(0, len(start), step):
            b = min(a + step, len(start))
            lo, hi = start[a], end[b - 1]
            part = np.take(tables[0], pairs[lo:hi], 0)
            part += np.take(tables[1], pairs[lo + 1 : hi + 1], 0)
            part += np.take(tables[2], pairs[lo + 2 : hi + 2], 0)
            cuts = np.empty(2 * (b - a), np.int64)
            cuts[::2], cuts[1::2] = start[a:b] - lo, end[a:b] - lo
            pooled[a:b] = np.maximum.reduceat(np.concatenate([part, part[-1:]]), cuts, axis=0)[::2]
        z, _ = self._head(pooled, text, n)
        return 1 / (1 + np.exp(-(z.astype(np.float64) + self.shift)))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, epochs: int = EPOCHS) -> Network:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold, whole texts of ``train_bytes`` for each label."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    marked = labels.where(F.col(label_col).isin(0, 1) & (crc % folds != held)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    share = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    picked = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(train_rows // 2).collect()]
    labelled = docs.sparkSession.createDataFrame([(r.i, r.y) for r in picked], f"i {labels.select(id_col).schema[0].dataType.simpleString()}, g int")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(labelled), "i").select("g", "i", "t")
    got = sorted(((i, t, y) for y, i, t in sample.whole_texts(rows, [(r.y, r.i) for r in picked], train_bytes)), key=lambda r: r[0])
    net, y = Network(), np.array([r[2] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    net.fit([r[1].encode() for r in got], y, epochs=epochs)
    ones, zeros = share.get(1, 1), share.get(0, 1)
    net.shift = 0.5 * float(np.log(ones / zeros))  # the classes were balanced for learning
    return net


def _run(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                score = net.score(*tx.buffers(part.column(1)), tables)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, **options) -> DataFrame:
    """id, held_out, score and predicted of every document."""
    net = learn(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held=held, **options)
    scratch.small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = thin.mapInArrow(_run(net), f"id {thin.schema[0].dataType.simpleString()}, score double")
    out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
