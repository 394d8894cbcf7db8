import hashlib
import random
import re

from pyspark.sql import functions as F

from gridframe.llm import decontamination as dc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(texts, items, window=10):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(len(ws) - window, 0) + 1 if ws else 0):
            windows.setdefault(tuple(ws[i : i + window]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        ws = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                owners = windows.get(tuple(ws[i : i + n]))
                if owners:
                    found |= owners
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(ws), len(hit), len(found), digest, bool(hit)))
    return out


def run(docs, bench, **options):
    got = dc.decontaminate(docs, bench, **options)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", dc.item_digest(F.col("items")).alias("d"), "contaminated")
    return [tuple(r)[1:] for r in sorted(got.collect(), key=lambda r: r[0])]


def test_against_brute_force(spark, docs_of):
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "été", "x1", "of", "the", "and", "zeta", "Ω"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(30)] + [(40, "!!"), (41, None), (None, "of the and of")]
    texts = []
    for _ in range(60):
        parts = r.choices(vocabulary, k=r.randrange(40))
        if r.random() < 0.6:
            ws = words(r.choice(items[:30])[1])
            at = r.randrange(max(len(ws) - 8, 1))
            parts[3:3] = ws[at : at + r.choice([9, 10, 12, 30])]
        texts.append(r.choice([" ", "\n", ", ", "--"]).join(parts).upper() if r.random() < 0.3 else " ".join(parts))
    texts += [None, "", "  ", "of"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, [(i, t) for i, t in items if i is not None and t is not None])
    docs = docs_of(texts)
    assert run(docs, bench) == want
    assert run(docs, bench, broadcast_rows=0) == want  # shuffled joins


def test_awkward_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three"), (1, "four five"), (2, "one two three")], "item_id long, text string").withColumn("hits", F.lit(3))
    docs = docs_of(["x one two three four five", "x one two three four five", None], ids=[1, 1, None]).withColumn("n_words", F.lit("clash")).withColumn("items", F.lit(0))
    got = run(docs.where("doc_id = 1"), bench)
    assert [g[:3] for g in got] == [(6, 5, 2)] * 2
    assert run(docs_of(["a b"]), bench.limit(0)) == [(2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert run(docs.limit(0), bench) == []


def test_long_text(spark, docs_of):
    text = "w " * 400_000 + "needle in hay " + "w " * 400_000
    bench = spark.createDataFrame([(7, "needle in hay")], "item_id long, text string")
    assert run(docs_of([text]), bench)[0][:3] == (800_003, 3, 1)


def test_repeated_passages_and_copies(spark, docs_of, monkeypatch):
    """A text of nothing but one word, copies of a contaminated text, and a filter that lets nearly all through."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = ["w " * 5000, *[f"intro {passage} outro"] * 40, "w w w", " ".join(f"p{i}" for i in range(9)), f"{passage} {passage}"]
    items = [(1, "w " * 12), (2, passage), (3, passage + " more"), (4, "p3 p4"), (5, "none of it")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert run(docs_of(texts), bench) == want
    monkeypatch.setattr(dc, "FILTER_BITS", (6, 6))
    assert run(docs_of(texts), bench) == want


def test_prefixes_are_the_rarest_shingles(spark):
    windows = spark.createDataFrame([("a b c d", 4, 3, [11, 22]), ("a b c e", 4, 3, [11, 33])], "words string, n int, k int, hashes array<long>")

    class Counted:  # stands for the texts: shingle 11 three times, 22 once, 33 never
        def mapInArrow(self, fn, schema):
            return spark.createDataFrame([(3, 11, 2), (3, 11, 1), (3, 22, 1), (3, 99, 5)], schema)

    got = dc.prefixes(windows, Counted()).collect()
    assert [(r.sh, r.off, r.words) for r in got] == [(22, 1, "a b c d")]
