import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridframe.llm import language_id, quality_model

MEDIUM = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_learns_from_its_folds_only(docs_of):
    """Labels of held-out rows and of rows without text or language change nothing."""
    texts = [("the quick brown fox %d" if i % 2 else "le renard brun rapide %d") % i for i in range(80)]
    langs = ["en" if i % 2 else "fr" for i in range(80)]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80)]
    a = language_id.identify(docs_of(texts, langs=langs)).orderBy("doc_id").collect()
    b = language_id.identify(docs_of(texts, langs=["xx" if h else x for h, x in zip(held, langs)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert [r.lang_pred for r in a] == langs


def test_language_awkward_rows(docs_of):
    texts = ["words of english here"] * 12 + [None, "", "123 !!", "é", "Ω", "x", "mots de français ici"]
    docs = docs_of(texts, langs=["en"] * 18 + [None]).withColumn("score", F.lit("clash")).withColumn("k0", F.lit(1))
    got = [r.lang_pred for r in language_id.identify(docs).orderBy("doc_id").collect()]
    assert got[12:15] == ["und"] * 3 and got[15:] == ["en"] * 4
    assert language_id.identify(docs.limit(0)).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_every_labelled_language_is_learned(docs_of):
    names = [f"l{k:03}" for k in range(130)]
    texts = ["".join(chr(97 + (7 * k + j * (k + 3)) % 26) for j in range(40)) + f" {chr(97 + k % 26) * 5}{chr(97 + k // 26) * 6}" for k in range(130)]
    model = language_id.learn(docs_of(texts, langs=names), F.lit(True))
    assert sorted(model.names) == names and len(model.tables) == 3
    raws = [t.encode() for t in texts]
    best, _, known = model.score(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    assert [model.names[b] for b in best] == names
    assert known.min() > 0.9  # a language of one document is learned as well


def test_bloom_answers_all_languages():
    model = language_id.Model({"a": ["shared words only a"] * 3, "b": ["shared words only b"] * 3})
    raw = np.frombuffer(b"shared words", np.uint8)
    best, score, known = model.score(raw, np.array([0, len(raw)]))
    assert model.names[best[0]] in ("a", "b") and 0.45 < score[0] < 0.55 and known[0] > 0.5
    assert (model.false < 0.01).all()


def plain_grams(text, n=language_id.NGRAM):
    """N-grams over letters; anything else is one space."""
    out = bytearray(b" ")
    for b in text.encode() + b" ":
        b = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or out[-1] != 32:
            out.append(b)
    return [bytes(out[i : i + n]) for i in range(len(out) - n + 1)]


def test_filter_against_plain_sets():
    """Counts of the filter are those of plain sets, but for the stated rate of false answers."""
    r = np.random.default_rng(4)
    words = {k: ["".join(r.choice(list(letters), r.integers(2, 9))) for _ in range(400)] for k, letters in (("x", "abcdefgh"), ("y", "efghijkl"), ("z", "äöüßabcd"))}
    samples = {k: [" ".join(r.choice(w, 120)) for _ in range(30)] for k, w in words.items()}
    model = language_id.Model(samples)
    sets = {}
    for k, texts in samples.items():
        values, counts = np.unique([g for t in texts for g in plain_grams(t)], return_counts=True)
        sets[k] = set(values[counts >= language_id.LEAST].tolist())
    assert (model.false < 0.01).all()
    for text in [t for k in "xyz" for t in samples[k][:5]] + [" ".join(r.choice(words["x"] + words["z"], 300)), "QQ qq, 12 Äö"]:
        grams = plain_grams(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        h, _ = language_id._grams(raw, np.array([0, len(raw)]), language_id.NGRAM)
        assert len(h) == len(grams)
        mask = np.full(len(h), 255, np.uint8)
        for s in model._slots(h):
            mask &= model.tables[0][s]
        for i, k in enumerate(model.names):
            true = np.array([g in sets[k] for g in grams])
            said = (mask >> i) & 1 == 1
            assert said[true].all()  # no false negatives
            assert (said & ~true).sum() <= 5 + 3 * model.false[i] * len(grams)
        best, _, _ = model.score(raw, np.array([0, len(raw)]))
        corrected = [max(sum(g in sets[k] for g in grams), 0) for k in model.names]
        if sorted(corrected)[-1] > 1.05 * sorted(corrected)[-2] + 5:
            assert best[0] == int(np.argmax(corrected))


def test_filter_grows_with_the_sample():
    r = np.random.default_rng(1)
    long = ["".join(chr(c) for c in r.integers(97, 123, 60_000)) for _ in range(3)]
    model = language_id.Model({"a": long, "b": ["few words"]})
    assert model.bits > language_id.SLOT_BITS or (model.false < 0.01).all()
    huge = language_id.Model({"a": ["".join(chr(c) for c in r.integers(97, 123, 200_000))], "b": ["few words"]})
    assert huge.bits > language_id.SLOT_BITS and (huge.false < 0.01).all()


def test_letters_ties_and_long_texts(docs_of):
    learnable = ["same words for both"] * 9
    texts = [*learnable, "½ ②", "²³ __ 7", "ª", "語", "same words " * 200_000]
    got = language_id.identify(docs_of(texts, langs=["b", "b", "a", "b", "b", "b", "b", "b", "b", *[None] * 5])).orderBy("doc_id").collect()
    assert [g.lang_pred for g in got[9:11]] == ["und", "und"] and "und" not in [g.lang_pred for g in got[11:]]
    model = language_id.learn(docs_of(learnable * 100, langs=["b"] * 500 + ["a"] * 400), F.lit(True), train_docs=10)
    assert model.names == ["b", "a"]  # by labelled rows, not by rows of the sample
    raw = np.frombuffer(b"same words", np.uint8)
    assert model.score(raw, np.array([0, len(raw)]))[0][0] == 0  # a tie


def test_samples_are_bounded(spark):
    """Repeated ids are learned once; whole texts come as far as the bytes go, one at least."""
    from gridframe.llm import sample

    rows = spark.createDataFrame([("a", 1, "x" * 10), ("a", 1, "y" * 10), *[("a", 2, "z" * 50)] * 20, ("a", 3, None), ("b", 1, "w" * 500), ("b", 2, "v"), ("c", 9, "u")], "g string, i int, t string")
    got = sample.whole_texts(rows, [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 7)], 40)
    assert [(g, i, len(t)) for g, i, t in got] == [("a", 1, 10), ("a", 3, 0), ("b", 1, 500)]
    assert sample.whole_texts(rows, [], 40) == []


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = quality_model.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 0].predicted == 0).mean() > 0.8
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()


def test_quality_ignores_held_out_labels(spark, docs_of):
    texts = [("plain words in a row %d" % i) * 8 if i % 3 else "#### !!!! %d" % i * 8 for i in range(60)]
    y = [int(i % 3 > 0) for i in range(60)]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(60)]

    def score(labels):
        df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(labels)], "doc_id long, quality int, toxic int")
        return [r.score for r in quality_model.classify(docs_of(texts), df, epochs=4).orderBy("doc_id").collect()]

    a, b = score(y), score([1 - v if h else v for h, v in zip(held, y)])
    assert a == b and len(set(a)) > 2


def test_tables_equal_convolution():
    """Scoring by look-ups is the network that was trained."""
    net = quality_model.Network(3)
    texts = [b"", b"a", b"ab" * 700, bytes(range(256)) * 3, b"x" * 129]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    got = net.score(raw, offs, net.tables())
    p = net.p
    for text, s in zip(texts, got):
        n = (len(text) + 1) // 2
        data = np.frombuffer(text.ljust(2 * n + 6, b"\0"), np.uint8)
        conv = np.array([sum(p["E"][data[2 * i + j]] @ p["K"][j] for j in range(6)) for i in range(n + 1)])
        halves = [conv[i : i + 64].max(0) for i in range(0, len(conv), 64)]
        chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
        mean = np.mean([np.tanh(c + p["c"]) for c in chunks], 0)
        z = np.tanh(mean @ p["V"] + p["d"]) @ p["w"] + p["b"][0]
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_gradients():
    net = quality_model.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"hello world " * 12, b"!! ## " * 30]
    raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    y, w = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        bytes_, at = quality_model._layout(raw, offs)
        z = np.log(1 / (1 / np.clip(net.score(raw, offs, net.tables()), 1e-9, 1 - 1e-9) - 1))
        return float(np.sum(w * (np.log1p(np.exp(z)) - y * z)) / 2)

    g = net._gradients(raw, offs, y, w)
    for name, at in (("w", (3,)), ("V", (2, 5)), ("K", (1, 2, 3)), ("E", (ord("l"), 4)), ("b", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)


def test_quality_awkward_rows(spark, docs_of):
    docs = docs_of(["abc", None, "", "x" * 300_000], ids=[1, 1, None, 4]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_model.classify(docs, labels).collect()] == [0.5] * 4
    assert quality_model.classify(docs.limit(0), labels.limit(0)).count() == 0
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, both, epochs=1).toPandas()
    assert len(got) == 4 and not pd.isna(got.score).any()
