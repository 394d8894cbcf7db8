"""Vectorised text primitives: whole Arrow columns as one byte buffer.

Word classes used here are closed under UTF-8: every delimiter is ASCII, so a
byte table finds the same words as the character class does.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
SHINGLE_CODES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of ``[^\x20\x09-\x0D]+``
NONSPACE = ~SPACES
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_steady: list[bool] = []  # set once in a worker


def steady_memory() -> None:
    """Have freed arrays of a MB and more go back to the system at once.

    Workers live on between tasks; by default the allocator raises the size
    from which it does so, and keeps what tasks have freed.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit hashes."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        size = -(-n // (1 << 18)) << 18
        step = np.full(size, _BASE if which == "up" else _INV, U64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[which] = np.multiply.accumulate(step)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts take about ``limit`` bytes."""
    if not _steady:
        _steady.append(True)
        steady_memory()
    _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last)."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    w = table[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before[offs[offs < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    last = offs[offs > 0] - 1
    after[last] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2**64."""
    out = np.zeros(len(raw) + 1, U64)
    codes = BYTE_CODES[raw]
    codes *= _power("up", len(raw))
    np.cumsum(codes, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes anywhere."""
    h = prefix[ends] - prefix[starts]
    h *= _power("down", len(prefix))[starts]
    h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, for every start (texts not regarded)."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * SHINGLE_CODES[j]
    return mix(out)


def repeat_index(bounds: np.ndarray) -> np.ndarray:
    """Index of the text each word belongs to, from word bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
