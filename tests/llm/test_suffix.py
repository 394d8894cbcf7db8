import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridframe.llm import suffix
from gridframe.llm import suffix_dedup as sd
from gridframe.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([4, 10, 50]))
def test_order_and_common_prefixes(data, depth):
    raw = np.frombuffer(data, np.uint8)
    sa = suffix.suffix_array(suffix.byte_keys(raw), 8, depth)
    heads = [data[i : i + depth].ljust(depth, b"\0") if i + depth > len(data) else data[i : i + depth] for i in sa.tolist()]
    assert heads == sorted(heads) and sorted(sa.tolist()) == list(range(len(data)))
    got = suffix.common_prefixes(raw, sa, depth)
    for k in range(1, len(sa)):
        a, b = data[sa[k - 1] :], data[sa[k] :]
        n = next((j for j in range(min(len(a), len(b), depth)) if a[j] != b[j]), min(len(a), len(b), depth))
        assert got[k] == n


def brute(rows, length):
    first = {}
    for i, t in rows:
        if i is not None:
            for p in range(len(t) - length + 1):
                w = t[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            least = first.get(t[p : p + length])
            if least is not None and (i is None or least < i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, **options):
    got = sd.remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(docs_of, seed):
    r = random.Random(seed)
    pool = ["".join(r.choices("abé \n", k=r.randrange(30, 140))) for _ in range(12)]
    texts = []
    for _ in range(70):
        t = "".join(r.choice(pool) if r.random() < 0.5 else "".join(r.choices("abcdé ", k=r.randrange(60))) for _ in range(r.randrange(6)))
        texts.append(t)
    texts += ["x" * 49, "x" * 50, "x" * 50, "x" * 700, "xy" * 80, "", None, None]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, (t or "").encode()) for i, t in zip(ids, texts)]
    assert run(docs_of(texts, ids=ids)) == brute(rows, 50)


def test_repeated_ids_nulls_and_clashes(docs_of):
    a, b = "the quick brown fox " * 6, "jumps over the lazy dog; " * 5
    docs = docs_of([a, a + b, a, b, b], ids=[1, 1, 2, None, None]).withColumn("kept", F.lit(1)).withColumn("spans", F.lit("x"))
    want = brute([(1, a.encode()), (1, (a + b).encode()), (2, a.encode()), (None, b.encode()), (None, b.encode())], 50)
    assert run(docs) == want
    assert run(docs.limit(0)) == []


def test_merge_of_shards(monkeypatch):
    """A hot anchor split over several suffix arrays decides as one."""
    r = np.random.default_rng(4)
    core = r.integers(97, 100, 16).astype(np.uint8)
    parts, ids = [], []
    for i in range(300):
        k = int(r.integers(0, 8))
        parts.append(np.concatenate([np.full(30, 97 + k, np.uint8), core, np.full(30, 97 + k % 3, np.uint8)]))
        ids.append(int(r.integers(0, 90)))
    size = np.array([len(p) for p in parts])
    off = np.cumsum(size) - size
    content, ids, anchor = np.concatenate(parts), np.array(ids), np.zeros(300, np.uint64)
    whole = sorted(zip(*[x.tolist() for x in sd.decide(content, off, size, ids, anchor, 50, 1 << 20)]))
    split = sorted(zip(*[x.tolist() for x in sd.decide(content, off, size, ids, anchor, 50, 200)]))
    assert whole == split and len(whole) > 100


def test_long_text(docs_of):
    r = random.Random(9)
    text = "".join(r.choices("abcdefgh ", k=2_500_000))
    got = run(docs_of([text, text[1_000_000:1_000_060] + "tail"]))
    assert [g[1:4] for g in got] == [(2_500_000, 0, 0), (64, 60, 1)]


def test_query_is_whole(spark, sf):
    assert QUERIES["op6_suffix_dedup"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
