import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridframe.llm import decontamination, mixing, near_join, queries, scratch, secret_scan


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        got = scratch.table(stage(spark, docs, sf))
        out.append((docs, got))
        docs = got
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert 0 < after.count() <= before.count()


def test_language_keeps_documents_in_known_languages(spark, stages, docs_of):
    assert stages[0][1].count() == stages[0][0].count()
    docs = docs_of(["the cat sat on the mat and the dog lay by the door"] * 12 + ["12345 !!", None, "щука рак лебедь " * 5], langs=["en"] * 14 + [None])
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == list(range(12))


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    groups = near_join.group_near_copies(before, shingle=5, percent=80).toPandas()
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(groups.component_id.unique())


def test_nothing_of_the_benchmark_is_left(spark, stages, sf):
    before, after = stages[2]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontamination.decontaminate(before, bench)
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r.doc_id for r in found.where("not contaminated").collect())


def test_no_secret_is_left(stages):
    before, after = stages[3]
    assert before.count() == after.count()
    kinds = [r.kind for r in secret_scan.RULES]
    left = [s for r in secret_scan.scan(after).collect() for s in r.spans if s["kind"] in kinds and s["kind"] != "assign"]
    assert left == []
    merged = after.join(before.withColumnRenamed("text", "was"), "doc_id").toPandas()
    assert (merged[~merged.was.str.contains(r"(?i)token|secret|passw|api|[0-9a-f]{24}")].pipe(lambda d: d.text == d.was)).all()


def test_mix(stages):
    before, after = stages[4]
    want = mixing.mix(before).where("copies > 0").select("doc_id", "copies", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    got = after.select("doc_id", "copies", "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want) and "text" in after.columns


def test_run(spark, stages, sf):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1][1].count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    key = [k for k in ("doc_id", "page_id") if k in got][0]

    def normal(df):
        df = df[sorted(df.columns)].sort_values(key).reset_index(drop=True)
        return df.map(lambda v: None if pd.isna(v) else v).astype(object)

    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=1e-12)


def test_stages_over_awkward_rows(spark, docs_of, tmp_path):
    """Nulls in every column, repeated rows, one id with two texts, an empty and a long text, clashing names, through all stages."""
    sentence = "the cat sat on the mat and the dog lay by the door of house number {} in street {} of the town {} where {} people live near the sea "
    texts = [sentence.format(*(f"{w}{i}" for w in "abcd")) * (1 + i % 3) for i in range(40)]
    window = "one two three four five six seven eight nine ten eleven"
    extra = [
        (100, texts[0], "en", "s", 1), (101, texts[0] + "x", "en", "s", 1),  # a copy and a near copy
        (102, texts[3], "en", "s", 1), (102, "another text of its own with words that no other one has in this table", "en", "t", None),
        (103, "the dog lay by the door of the house near the sea and " * 3 + window + " the cat sat on the mat" * 3, "en", None, 5), (104, "my token=abcdef123456 is in the mat by the door", "en", "t", 5),
        (None, texts[5] + " with an end that makes it another text, longer than the one that it is like " * 3, "en", "s", 5),
        (105, None, None, None, None), (106, "", "en", "s", 0), (107, "12345 !!", None, "s", 8), (108, "the mat and the door of house " * 20_000, "en", "long", 9),
    ]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)] + extra + [extra[1]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("copies", "size", "taken", "hits", "items", "spans", "id", "cls", "k0", "host", "known", "key"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    spark.createDataFrame([(1, window), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = scratch.table(stage(spark, docs, f"file://{tmp_path}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
        kept[name] = got.toPandas()
        docs = got
    first, second, third, fourth, last = kept.values()
    assert {105, 106, 107}.isdisjoint(first.doc_id.dropna()) and len(first) == len(rows) - 3
    assert set(range(40)) <= set(second.doc_id.dropna()) and {100, 101}.isdisjoint(second.doc_id.dropna())
    assert second[second.doc_id == 102].text.tolist() == [extra[3][1]]  # of one id the copy goes, the other text stays
    assert second.doc_id.isna().sum() == 1
    assert 103 in set(second.doc_id) and set(second.doc_id.dropna()) - set(third.doc_id.dropna()) == {103}
    assert fourth[fourth.doc_id == 104].text.tolist() == ["my token=[REDACTED] is in the mat by the door"] and len(fourth) == len(third)
    assert {"doc_copies", "doc_size", "doc_taken", "copies", "size", "taken", "hits", "text"} <= set(last.columns) and (last.doc_copies == "own copies").all()
    assert set(last.doc_id.dropna()) <= set(fourth.doc_id.dropna()) and (last.copies >= 1).all()
    empty = spark.createDataFrame([], docs_of(["x"]).schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0
