import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridframe.llm import mixing


def water_fill(sizes, share, cap, weights):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        if not free:
            return {s: cap * sizes[s] for s in names}
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_targets_and_words(docs_of):
    r = 0
    texts, sources = [], []
    for s, n in (("a", 40), ("b", 300), ("c", 80), (None, 25)):
        for i in range(n):
            r = (r * 1103515245 + 12345) % 2**31
            texts.append("w " * (r % 60 + 1))
            sources.append(s)
    got = mixing.mix(docs_of(texts, sources), keep=("source",)).toPandas()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["source_size"]).all()
    sizes = {None if pd.isna(s) else s: v for s, v in per["size"].items()}
    want = water_fill(sizes, 1.5, 2.0, (3, 1, 2))
    for s, row in per.iterrows():
        assert row.target == pytest.approx(want[None if pd.isna(s) else s])
        assert row.taken == pytest.approx(row.target, rel=0.02)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all() and (got.taken == got.copies * got["size"]).all()
    assert per.target.sum() == pytest.approx(1.5 * per["size"].sum())


@pytest.mark.parametrize("sizes", [[5], [1, 1, 100], [100, 1, 1, 50], [0, 10], [7, 0, 0, 3, 9, 2]])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "_src string, source_size long")
    got = {r._src: r.target for r in mixing.targets(df, 1.5, 2.0, (3, 1, 2)).collect()}
    assert got == pytest.approx(water_fill({f"s{i}": n for i, n in enumerate(sizes)}, 1.5, 2.0, (3, 1, 2)))


def test_reruns_and_partitioning_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = mixing.mix(docs).select("doc_id", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    b = mixing.mix(docs.repartition(7)).select("doc_id", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)


def test_certain_copies_and_sampled_ones(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 40 else "b") for i in range(200)], "doc_id long, text string, source string")
    seen = [0] * 200
    for k in range(6):
        for r in mixing.mix(docs, seed=f"s{k}").collect():
            seen[r.doc_id] += r.copies
    assert seen[:40] == [12] * 40  # the cap: two certain copies each time
    rest = seen[40:]  # 1.375 copies expected each time
    assert min(rest) >= 6 and max(rest) <= 12 and abs(sum(rest) / 6 / 160 - 1.375) < 0.01 and len(set(rest)) > 3


def test_odds_follow_size(spark):
    """Within a stratum (sizes 64 to 71) the share of draws is in proportion to size."""
    sizes = [64, 71] * 60
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    drawn = {64: 0, 71: 0}
    for k in range(5):
        got = mixing.mix(docs, share=0.3, seed=f"s{k}").collect()
        assert abs(sum(r.taken for r in got) - 0.3 * sum(sizes)) <= 72  # one sample of fixed size
        for r in got:
            drawn[r["size"]] += r.copies
    assert 0.8 < drawn[71] / drawn[64] < 1.5  # 71 / 64 = 1.11, and chance
    assert drawn[64] + drawn[71] == pytest.approx(5 * 36, abs=5)


def test_repeated_rows_and_null_ids(docs_of):
    """25 rows of one id and text in each source, then null ids: both within a document of the target."""
    texts = [t for s in "ab" for t in ["w " * 40] * 25 + [f"x{i} " * (10 + i) for i in range(60)]]
    sources = [s for s in "ab" for _ in range(85)]
    ids = [i for s in range(2) for i in [1000 + s] * 25 + [2000 + 100 * s + j for j in range(60)]]
    for own in (ids, [None] * len(ids)):
        docs = docs_of(texts, sources, ids=own) if own[0] else docs_of(texts, sources, ids=ids).withColumn("doc_id", F.lit(None).cast("long"))
        got = mixing.mix(docs, keep=("source", "n_chars")).toPandas()
        assert len(got) == len(texts)
        for _, rows in got.groupby("source"):
            assert abs(rows.taken.sum() - rows.target.iloc[0]) <= 70
        assert (got.taken <= 2 * got["size"]).all()


def test_clashing_names(docs_of):
    docs = docs_of(["a b", "c d e"]).withColumn("copies", F.lit("mine")).withColumn("doc_copies", F.lit(7)).withColumn("size", F.lit(1.5))
    got = mixing.mix(docs, keep=("copies", "doc_copies", "size", "text"))
    assert got.columns == ["doc_id", "size", "source_size", "target", "copies", "taken", "doc_doc_copies", "doc_copies", "doc_size", "text"]
    row = got.where("size = 3").first()
    assert (row["doc_doc_copies"], row["doc_copies"], row["doc_size"], row["text"]) == ("mine", 7, 1.5, "c d e")


def test_long_text_and_words_for_none(docs_of):
    got = mixing.mix(docs_of(["w " * 300_000, "", None, *["v " * 30] * 40])).orderBy("doc_id").collect()
    assert [r["size"] for r in got[:3]] == [300_000, 0, 0] and [r.copies for r in got[1:3]] == [0, 0]
    assert sum(r.taken for r in got) > 0


def test_awkward_rows(docs_of, spark):
    docs = docs_of(["a b c", None, "", "x", "x", "y z"], ["s", "s", None, None, None, "t"], ids=[1, 2, None, 4, 4, None]).withColumn("size", F.lit("clash")).withColumn("_k", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and {r["size"] for r in got} == {0, 1, 2, 3}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.select("doc_id", "source", F.lit(None).cast("string").alias("text"))).agg(F.sum("taken")).first()[0] == 0


def test_no_python_in_the_plan(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
