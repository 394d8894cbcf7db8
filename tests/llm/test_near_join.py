import random
import re

import pytest
from pyspark.sql import functions as F

from gridframe.llm import components, hot, near_join, scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return set(zip(*[ws[j:] for j in range(k)])) if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted([(i, len(s), least.get(find(x))) for x, (i, s) in enumerate(sets)], key=str)


def near_copies(r, groups, members, words):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=words)
        for _ in range(members):
            t = list(base)
            for _ in range(r.randrange(int(words * 0.06) + 2)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t) if r.random() < 0.8 else " ".join(t[: len(t) - r.randrange(3)]).upper())
    return texts


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("words", [6, 30, 150])
def test_against_all_pairs(docs_of, k, percent, words):
    r = random.Random(words + k)
    texts = near_copies(r, 12, 9, words) + ["a", "A", "b c", "b  c", "c b", None, "", " \n", "a b c d", "A B C D e"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = near_join.group_near_copies(docs_of(texts, ids=ids), shingle=k, percent=percent)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(list(zip(ids, texts)), k, percent)


def test_hot_groups_are_split(docs_of, monkeypatch):
    monkeypatch.setattr(near_join, "CELL", 7)
    monkeypatch.setattr(near_join, "HUB_MEMBERS", 5)
    monkeypatch.setattr(near_join, "FLUSH_ROWS", 50)
    monkeypatch.setattr(near_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(components, "VERTEX_ROWS", 5)
    monkeypatch.setattr(hot.lookup, "__defaults__", ("inner", 5, None))
    r = random.Random(2)
    texts = near_copies(r, 1, 90, 60)
    texts += texts[:1] * 40
    got = near_join.group_near_copies(docs_of(texts))
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(list(enumerate(texts)), 4, 85)


@pytest.mark.parametrize("counted", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_hot_keys(spark, how, counted):
    """Cells hold about the limit, and the result is that of a plain join."""
    keys = [1] * 60 + [2] * 25 + [3, 4, 4, None, None, 9]
    rows = scratch.table(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long"))
    table = spark.createDataFrame([(k, f"t{k}", keys.count(k)) for k in (1, 2, 3, 4, 5)], "k long, t string, size long")
    table = table if counted else table.drop("size")
    got, want = hot.lookup(rows, table, "k", how, 10), rows.join(table.drop("size"), "k", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert hot.lookup(rows.limit(0), table, "k", how, 10).count() == 0


def test_bands_lose_no_pair():
    """Similar sizes share a band, and their largest difference is below the number of parts."""
    bands = near_join.Bands()
    for a in [*range(1, 400), 1000, 5000]:
        for b in range(a, a * 100 // 85 + 1):
            assert bands.of(-(-b * 85 // 100)) <= bands.of(a) <= bands.of(b)
            s = int(bands.of(a))
            assert bands.most_different(a, b) + bands.spare[s] < bands.parts[s]


def test_components(spark):
    r = random.Random(1)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(r.randrange(99), r.randrange(99)) for _ in range(70)]):
        code = {v: r.getrandbits(60) for e in edges for v in e}
        df = spark.createDataFrame([(code[a], code[b]) for a, b in edges], "a long, b long")
        got = {x.v: x.comp for x in components.components(df).collect()}
        parent = {v: v for v in code}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        for a in code:
            for b in code:
                if code[a] in got and code[b] in got:
                    assert (got[code[a]] == got[code[b]]) == (find(a) == find(b))
    assert components.components(df.limit(0)).count() == 0


def test_awkward_tables(docs_of):
    t = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([t, t, t, t, None], ids=[5, 5, 3, None, None]).withColumn("component_id", F.lit("x")).withColumn("n", F.lit(0))
    got = sorted((tuple(x) for x in near_join.group_near_copies(docs).collect()), key=str)
    assert got == sorted([(5, 47, 3), (5, 47, 3), (3, 47, 3), (None, 47, 3), (None, 0, None)], key=str)
    assert near_join.group_near_copies(docs.limit(0)).count() == 0
    long = " ".join(f"v{i}" for i in range(60_000))
    assert {r.component_id for r in near_join.group_near_copies(docs_of([long, long + " more", "x y"])).collect()} == {0, 2}


def test_keep_one(docs_of):
    t = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([t, t + " z", "other words", None, "other words"], ids=[4, 2, 7, 8, 7]).withColumn("i", F.lit(2)).withColumn("component_id", F.lit("x"))
    got = near_join.keep_one(docs)
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 8] and got.columns == docs.columns


def test_keep_one_tells_rows_of_one_id_apart(docs_of):
    t = " ".join(f"w{i}" for i in range(50))
    texts = [t, t + " z", "a text of its own", "a text of its own", None, "other words", t]
    docs = docs_of(texts, ids=[2, 4, 4, 4, 4, 7, 7]).withColumn("cls", F.lit("x"))
    got = near_join.keep_one(docs)
    assert sorted((r.doc_id, r.text) for r in got.where("text is not null").collect()) == [(2, t), (4, "a text of its own"), (7, "other words")]
    assert got.where("text is null").count() == 1 and got.columns == docs.columns
