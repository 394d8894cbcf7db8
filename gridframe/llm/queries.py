"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, html_text, language_id, mixing, near_join, quality_model, quality_rules, secret_scan, suffix_dedup, url_filter


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    found = decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontamination.item_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op3_quality_model(spark, sf_dir):
    return quality_model.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_text(spark, sf_dir):
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op8_near_join(spark, sf_dir):
    return near_join.group_near_copies(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [r.kind for r in secret_scan.RULES if r.base]
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_quality_rules(spark, sf_dir):
    ruled = quality_rules.apply_rules(_read(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_quality_model": op3_quality_model,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_text": op7_html_text,
    "op8_near_join": op8_near_join,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op8_near_join": near_join.ORACLE_SQL,
    "op9_secret_scan": secret_scan.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
}
