"""A corpus pipeline of five stages over the documents table.

Each stage takes what its predecessor kept, written as Parquet and read again,
and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import decontamination, language_id, mixing, near_join, scratch, secret_scan

#: least part of a text's n-grams that the predicted language must know
LEAST_KNOWN = 0.2


def _beside(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def _back(docs: DataFrame, found: DataFrame, text=None) -> DataFrame:
    """The columns of ``docs`` from a frame that carries them as k0, k1 .. and text."""
    names = {c: f"k{i}" for i, c in enumerate(_beside(docs))}
    return found.select(*[(F.col("text") if text is None else text).alias(c) if c == "text" else F.col(names[c]).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the corpus' own labels teach."""
    model = language_id.learn(docs, F.lit(True))
    found = language_id.predict(docs, model, keep=tuple(_beside(docs)))
    return _back(docs, found.where((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_join.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_hits(docs, benchmark, keep=tuple(_beside(docs)))
    return _back(docs, found.where(F.size("hits") == 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays."""
    found = secret_scan.find_spans(docs, keep=tuple(_beside(docs)))
    clean = secret_scan.redact(F.col("text"), F.col("spans"))
    out = _back(docs, found.withColumn("text", clean))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their copies."""
    return mixing.mix(docs, keep=tuple(c for c in docs.columns if c != "doc_id")).where("copies > 0")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: the stages learn, join and sample: SQL can't express them, tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
