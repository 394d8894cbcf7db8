"""Quality rules per document, and host-level verdicts from shrunk failure rates.

Document measures are counted over the whole text.  A document fails when its
base rule fails (too few words, or too many repeated ones) or when symbols or
repeated lines prevail.  Failures of each rule are summed per host (the source
column).  For each rule a beta prior is fitted by moments: hosts weigh by their
documents, and the sampling error of their rates is taken off the variance
between them.  Each host's rates are shrunk towards the priors, and a host that
exceeds the limit of any rule takes all its documents with it.  The limit
follows from the prior: ``DEVIATIONS`` of its standard deviations above its
mean and at least twice the mean, but never above ``HOST_LIMIT``.

Defined results: null text counts as empty; null hosts form one host; an empty
table gives an empty table; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as tx

MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, LINE_PERCENT, HOST_LIMIT = 50, 50, 10, 50, 0.8
DEVIATIONS, STRENGTH = 3.0, (10.0, 1e4)  # least and greatest weight of a prior, in documents
CHUNK_BYTES = 1 << 20
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
BROADCAST_HOSTS = 20_000


def _per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offs[1:]] - sums[offs[:-1]]


def _repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of keys that an earlier entry of the same text has."""
    k = key ^ tx.mix(doc.astype(np.uint64) + tx.U64(1))
    by = np.argsort(k)
    same = np.flatnonzero(k[by[1:]] == k[by[:-1]])
    return by[same + 1], by[same]


def measure(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a buffer."""
    n = len(offs) - 1
    starts, ends, bounds = tx.words(raw, offs, tx.NONSPACE)
    prefix = tx.prefix_hash(raw)
    h = tx.span_hash(prefix, starts, ends)
    doc = tx.repeat_index(bounds)
    out = {"n_words": np.diff(bounds), "word_chars": _per_text(tx.NONSPACE[raw] & ((raw & 0xC0) != 0x80), offs), "n_symbols": _per_text(_SYMBOLS[raw], offs)}

    breaks = np.flatnonzero(raw == 0x0A)
    line_s = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    line_e = np.sort(np.concatenate([offs[1:], breaks]))
    line_d = np.sort(np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1]))
    full = np.searchsorted(starts, line_e) > np.searchsorted(starts, line_s)
    line_s, line_e, line_d = line_s[full], line_e[full], line_d[full]
    later, _ = _repeated(tx.span_hash(prefix, line_s, line_e), line_d)
    out["n_lines"] = np.bincount(line_d, minlength=n)
    out["n_dup_lines"] = np.bincount(line_d[later], minlength=n)

    s = tx.shingles(h, 3)
    inside = np.flatnonzero(doc[: len(s)] == doc[2:]) if len(h) >= 3 else np.zeros(0, np.int64)
    a, b = _repeated(s[inside], doc[inside])
    mark = np.zeros(len(h) + 1, np.int64)
    hit = np.zeros(len(h), bool)
    hit[inside[a]] = True
    hit[inside[b]] = True
    at = np.flatnonzero(hit)
    mark[at] += 1
    mark[at + 3] -= 1
    out["n_repeat_words"] = _per_text(np.cumsum(mark[:-1]) > 0, bounds)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch, "text", CHUNK_BYTES):
            got = measure(*tx.buffers(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(got[m].astype(np.int64)) for m in MEASURES]], ["id", "host", *MEASURES])


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host and the measures of each document."""
    scratch.small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kinds = [f"`{c}` {thin.schema[c].dataType.simpleString()}" for c in ("id", "host")]
    return thin.mapInArrow(_run, ", ".join([*kinds, *[f"{m} long" for m in MEASURES]]))


def rules() -> dict[str, Column]:
    """Each rule's condition of failure, over the measures."""
    return {
        "few": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    }


def prior(hosts: int, docs: int, mean: float, spread: float, limit: float = HOST_LIMIT) -> tuple[float, float]:
    """(strength, limit) of the prior of a rule that fails ``mean`` of ``docs``; ``spread``: weighted variance of the hosts' rates."""
    within = mean * (1 - mean)
    between = spread - within * hosts / docs
    strength = min(max(within / between - 1 if between > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1])
    return strength, min(max(mean + DEVIATIONS * math.sqrt(within / (strength + 1)), 2 * mean), limit)


def host_verdicts(failing: DataFrame, names: Sequence[str], limit: float = HOST_LIMIT) -> DataFrame:
    """(host, a condition for each rule) rows to host, n_docs, rate (the greatest shrunk one), host_ok.

    Only each rule's mean and variance come to the driver.
    """
    per = scratch.table(failing.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in names]))
    total = per.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), *[F.sum(r).alias(r) for r in names]).first()
    mean = {r: total[r] / total.docs if total.docs else 0.0 for r in names}
    off = {r: F.col(r) / F.col("n_docs") - F.lit(mean[r]) for r in names}
    spread = per.agg(*[(F.sum(F.col("n_docs") * off[r] * off[r])).alias(r) for r in names]).first()
    rates, ok = [], F.lit(True)
    for r in names:
        strength, most = prior(total.hosts, total.docs, mean[r], spread[r] / total.docs, limit) if total.docs else (STRENGTH[0], limit)
        rates.append((F.col(r) + F.lit(mean[r] * strength)) / (F.col("n_docs") + F.lit(strength)))
        ok &= rates[-1] <= F.lit(most)
    return per.select("host", "n_docs", F.greatest(*rates).alias("rate"), ok.alias("host_ok"))


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """id, the measures, base_failed, failed, rate (of the host) and kept."""
    m = scratch.table(measures(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    each = rules()
    hosts = scratch.table(host_verdicts(m.select("host", *[c.alias(r) for r, c in each.items()]), list(each), host_limit)).withColumnRenamed("host", "_host")
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    base = each["few"] | each["repeats"]
    m = m.withColumn("base_failed", base).withColumn("failed", base | each["symbols"] | each["lines"])
    m = m.join(side, m["host"].eqNullSafe(hosts["_host"]), "left")
    return m.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "failed", "rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lf AS (SELECT r, line FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lf GROUP BY r),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
rp AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM gg WHERE c > 1) GROUP BY r),
m AS (SELECT d.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w ON w.r = d.r LEFT JOIN lc ON lc.r = d.r LEFT JOIN rp ON rp.r = d.r),
f AS (SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS repeats, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS lines FROM m),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM (
    SELECT source, 'few' AS rule, few AS failed FROM f UNION ALL SELECT source, 'repeats', repeats FROM f
    UNION ALL SELECT source, 'symbols', symbols FROM f UNION ALL SELECT source, 'lines', lines FROM f) GROUP BY source, rule),
m1 AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(k) / sum(n) AS mean FROM h GROUP BY rule),
m2 AS (SELECT rule, mean, mean * (1 - mean) AS inside, sum(n * (k / n - mean) * (k / n - mean)) / any_value(docs) - mean * (1 - mean) * any_value(hosts) / any_value(docs) AS outside
    FROM h JOIN m1 USING (rule) GROUP BY rule, mean),
m3 AS (SELECT rule, mean, inside, least(greatest(CASE WHEN outside > 0 THEN inside / outside - 1 ELSE 1e4 END, 10.0), 1e4) AS strength FROM m2),
m4 AS (SELECT rule, mean, strength, least(greatest(mean + 3 * sqrt(inside / (strength + 1)), 2 * mean), 0.8) AS most FROM m3),
hv AS (SELECT source, bool_and((k + mean * strength) / (n + strength) <= most) AS ok FROM h JOIN m4 USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeats AS base_failed, (NOT (few OR repeats) AND ok) AS kept
FROM f JOIN hv ON f.source IS NOT DISTINCT FROM hv.source
"""
