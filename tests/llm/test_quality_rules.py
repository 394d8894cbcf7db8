import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gridframe.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {p for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(ws) < 50 or 100 * len(hit) > 50 * len(ws))


def test_measures_against_brute_force(docs_of):
    r = random.Random(5)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "x\ny\nx\nx", "\r\n", "é\x85ü Ω"]
    for _ in range(80):
        parts = r.choices(["a", "b", "été", "*$", "##", "word", "\n", "\n", "\t", "Ω|"], k=r.randrange(160))
        texts.append(r.choice([" ", "  "]).join(parts))
    got = qr.apply_rules(docs_of(texts)).orderBy("doc_id").collect()
    assert [(g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got] == [brute(t) for t in texts]
    assert all(not g.kept for g in got if g.base_failed)


def good(i):
    return " ".join(f"word{i}x{j}" for j in range(60))


def test_hosts(docs_of):
    texts = [good(i) for i in range(60)] + ["bad"] * 58 + [good(100), good(101)]
    got = qr.apply_rules(docs_of(texts, ["fine"] * 60 + ["foul"] * 60)).orderBy("doc_id").collect()
    assert [g.kept for g in got] == [True] * 60 + [False] * 60
    lone = qr.apply_rules(docs_of([good(i) for i in range(40)] + ["bad"], ["fine"] * 40 + ["new"])).orderBy("doc_id").collect()
    assert all(g.kept for g in lone[:40]) and lone[40].rate < 1  # one failure does not condemn a host


def test_host_limits_follow_from_the_priors(docs_of):
    """Verdicts against the formulas worked out host by host: one host stands out in one rule."""
    symbols = " ".join(["*#$%"] * 30 + [f"w{j}" for j in range(30)])
    texts, hosts = [], []
    for h in range(12):
        for i in range(60):
            texts.append(symbols + f" {h} {i}" if i < (24 if h == 5 else 3 + h % 2) else good(100 * h + i))
            hosts.append(f"h{h}")
    got = qr.apply_rules(docs_of(texts, hosts)).orderBy("doc_id").collect()
    assert {hosts[g.doc_id] for g in got if not g.kept} == {"h5"}
    assert not any(g.base_failed for g in got)
    k = [24 if h == 5 else 3 + h % 2 for h in range(12)]
    mean = sum(k) / 720
    spread = sum((x / 60 - mean) ** 2 for x in k) / 12
    within = mean * (1 - mean)
    strength = max(within / (spread - within * 12 / 720) - 1, 10.0)
    most = mean + 3 * (within / (strength + 1)) ** 0.5
    assert qr.prior(12, 720, mean, spread) == (strength, most)
    assert [(x + mean * strength) / (60 + strength) > most for x in k] == [h == 5 for h in range(12)]
    even = qr.apply_rules(docs_of([t for t, h in zip(texts, hosts) if h != "h5"], [h for h in hosts if h != "h5"]))
    assert even.where("not kept").count() == 0  # hosts that differ by chance alone


def test_awkward_tables(docs_of):
    docs = docs_of([good(0), good(0), None], [None, None, "s"], ids=[1, 1, None]).withColumn("host", F.lit(1)).withColumn("n_words", F.lit("clash"))
    got = qr.apply_rules(docs).collect()
    assert sorted((g.n_words, g.kept) for g in got) == [(0, False), (60, True), (60, True)]
    assert qr.apply_rules(docs.limit(0)).count() == 0
    assert qr.apply_rules(docs_of(["w%d " % 1 * 300_000])).first().n_words == 300_000
