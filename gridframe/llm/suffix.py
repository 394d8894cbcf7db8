"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy."""

from __future__ import annotations

import numpy as np

LANES = 16


def byte_keys(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like them."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= padded[j : j + n]
    return key


def suffix_array(key: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` symbols at least.

    ``key`` orders positions by their first ``width`` symbols.  Each round
    sorts only the groups not yet split, by the rank ``width`` symbols on, and
    doubles ``width``; a group is numbered by its first place, so numbers of
    finished groups never change.
    """
    n = len(key)
    sa = np.argsort(key)
    ordered = key[sa]
    first = np.ones(n, bool)
    first[1:] = ordered[1:] != ordered[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = head + 1  # 0 stands for the end of the text
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    while width < depth and len(open_):
        pos = sa[open_]
        pair = (rank[pos].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(pos + width, n)].astype(np.uint64)
        by = np.argsort(pair)
        pos, pair = pos[by], pair[by]
        sa[open_] = pos
        first = np.ones(len(pos), bool)
        first[1:] = pair[1:] != pair[:-1]
        rank[pos] = np.maximum.accumulate(np.where(first, open_, 0)) + 1
        open_ = open_[~(first & np.append(first[1:], True))]
        width *= 2
    return sa


def common_prefixes(seq: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each place of ``sa``, symbols in common with the place before, up to ``cap``.

    Kasai's rule, that the position after one with l symbols in common has
    l - 1 at least, is run in lanes: each lane takes consecutive positions.
    As suffixes are ordered to a depth only, the rule is used where the
    follower of the earlier neighbour does stand before the position.
    """
    n = len(sa)
    words = None
    if seq.dtype == np.uint8:  # eight symbols at a time
        words = np.ndarray((n + 1,), "<u8", np.concatenate([seq, np.zeros(16, np.uint8)]), strides=(1,))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.empty(n + 1, np.int64)
    place[sa] = np.arange(n)
    place[n] = n
    got = np.zeros(n, np.int32)
    last = behind = np.zeros(0, np.int64)
    for r in range(LANES):
        pos = np.arange(r, n, LANES)
        if not len(pos):
            break
        other = before[pos]
        have = np.zeros(len(pos), np.int64)
        if r:
            j = behind[: len(pos)] + 1
            have = np.where((j > 0) & (place[j] < place[pos]), np.maximum(last[: len(pos)] - 1, 0), 0)
        most = np.where(other < 0, 0, np.minimum(cap, n - np.maximum(pos, other)))
        have = np.minimum(have, most)
        live = np.flatnonzero(have < most)
        while len(live) and words is not None:
            differ = words[pos[live] + have[live]] ^ words[other[live] + have[live]]
            more = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            have[live] = np.minimum(have[live] + more, most[live])
            live = live[(more == 8) & (have[live] < most[live])]
        while len(live):
            same = seq[pos[live] + have[live]] == seq[other[live] + have[live]]
            live = live[same]
            have[live] += 1
            live = live[have[live] < most[live]]
        got[pos] = have
        last, behind = have, other
    return got[sa]
