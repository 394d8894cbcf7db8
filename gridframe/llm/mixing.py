"""Mixing sources to target weights by Pareto order sampling (native).

Every document of a source is due ``target / source size`` copies.  The whole
part is certain.  For the rest the source is cut into strata of documents of
nearly equal size (within an eighth), and each stratum gives a sample of fixed
size n with inclusion odds in proportion to size: document i is included with
probability p = n * size / (words of the stratum), and the n documents of least
``(u / (1 - u)) / (p / (1 - p))`` are taken, u being hashed from id and text.

Sample sizes follow from the words due, from the longest documents down: what a
stratum takes beyond or below its due, as a whole number of documents must, is
carried to the next one of shorter documents, and a stratum's last document is
drawn by a hashed number, so that long documents have their chance.  The strata
of the shortest documents, with up to a quarter of the source's words, are
planned last, when the words that the longer ones really took are known.  So the
words taken miss the target by little more than a short document.

Defined results: a document without words (null or empty text) is never taken;
null sources form one source, last in order; rows of equal id and text tie, and
of a tie at the cut as many rows are taken as the sample still needs, by a hash
of the kept columns; a source without words has target 0; an empty table gives
an empty table.  Kept columns that are named like a column of the result get the
prefix ``doc_`` (as often as it takes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SHARE, CAP, WEIGHTS, SEED, SLICES = 1.5, 2.0, (3.0, 1.0, 2.0), "mix-1", 1024
#: part of a source's words, in its shortest documents, that is planned last
LAST = 4  # one in LAST
#: strata (sources times classes of size) up to which figures are broadcast; shuffled joins beyond
BROADCAST_STRATA = 50_000
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _u(key: Column, seed: str) -> Column:
    """Uniform in (0, 1) from the first 52 bits of an md5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def _class(size: Column) -> Column:
    """Class of sizes: eight to each power of two, so exact up to 16; null for 0."""
    power = F.length(F.bin(size)) - 1
    return F.when(size > 0, power * 8 + F.call_function("shiftright", size * 8, power) - 8).cast("int")


def targets(sizes: DataFrame, share: float, cap: float, weights: Sequence[float]) -> DataFrame:
    """(src, source_size) to (.., target): weights in cycle, shares capped, excess reshared.

    Filling is in closed form: with sources ordered by cap / weight, the common
    level is the first, and so the largest, that the source's own cap allows.
    """
    w_of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", w_of)
    ranked = ranked.withColumn("_cap", F.lit(float(cap)) * F.col("source_size")).withColumn("_b", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_b", "_n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    filled = ranked.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        F.sum("_w").over(here_on).alias("_ws"),
    ).withColumn("_level", F.col("_left") / F.col("_ws"))
    level = F.max(F.when(F.col("_level") <= F.col("_b"), F.col("_level"))).over(total)
    return filled.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select("_src", "source_size", "target")


def _sample_sizes(strata: DataFrame, carry: Column) -> DataFrame:
    """(_src, _cls, _n): documents to take of each stratum (_src, _cls, _docs, _words, _due, _v), long documents first.

    A source has at most eight strata to a power of two of its greatest size.
    """
    stratum = F.struct("_cls", "_docs", "_words", "_due", "_v")
    start = F.struct(F.col("_carry").alias("carry"), F.array().cast("array<struct<_cls:int,_n:bigint>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        mean = x["_words"] / x["_docs"]
        due = x["_due"] + state["carry"]
        n = F.least(F.greatest(F.floor(due / mean + x["_v"]), F.lit(0)), x["_docs"]).cast("bigint")
        return F.struct((due - n * mean).alias("carry"), F.concat(state["out"], F.array(F.struct(x["_cls"].alias("_cls"), n.alias("_n")))).alias("out"))

    listed = strata.groupBy("_src").agg(F.sort_array(F.collect_list(stratum), False).alias("all"), F.first(carry).alias("_carry"))
    return listed.select("_src", F.inline(F.aggregate("all", start, step, lambda state: state["out"])))


def _ranked(rows: DataFrame) -> DataFrame:
    """With the ranking variable _k in [0, 1), 0 for certain documents, and its slice."""
    p = F.col("_n") * F.col("_size") / F.col("_words")
    q = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    k = F.when(p >= 1, F.lit(0.0)).otherwise(q / (1 + q))
    return rows.withColumn("_k", k).withColumn("_slice", F.floor(F.col("_k") * SLICES))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    cap: float = CAP,
    weights: Sequence[float] = WEIGHTS,
    seed: str = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken, then ``keep``.

    No stratum is sorted in one task: documents are counted by slice of the
    ranking variable, and only the slice that holds the last one is ordered.
    """
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    own = {
        "_src": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")),  # null last
        "_size": word_count(text),
        "_u": _u(F.concat(F.coalesce(id_, F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))), seed),
    }
    thin = scratch.table(docs.select(*[c.alias(n) for n, c in own.items()]).withColumn("_cls", _class(F.col("_size"))))
    counted = scratch.table(thin.groupBy("_src", "_cls").agg(F.count(F.lit(1)).alias("_docs"), F.sum("_size").alias("_words")))
    plan = targets(counted.groupBy("_src").agg(F.sum("_words").alias("source_size")), share, cap, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_whole", F.floor(ratio)).withColumn("_p", ratio - F.floor(ratio))
    short = F.sum("_words").over(Window.partitionBy("_src").orderBy("_cls"))
    strata = counted.join(plan, "_src").withColumn("_late", F.col("_cls").isNotNull() & ((LAST * short <= F.col("source_size")) | (short == F.col("_words"))))
    strata = strata.withColumn("_due", F.col("_p") * F.col("_words")).withColumn("_v", _u(F.concat("_src", F.lit(":"), F.col("_cls").cast("string")), seed))
    strata = scratch.table(strata)
    small = strata.count() <= BROADCAST_STRATA

    def beside(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on, how)

    def cut(sizes: DataFrame) -> DataFrame:
        """(.., _cut, _need, _tied, _least): the last ranking variable taken, rows to take of those that have it, their number and size."""
        rows = _ranked(beside(thin, beside(sizes.where("_n > 0"), strata.select("_src", "_cls", "_words"), ["_src", "_cls"]), ["_src", "_cls"]))
        by = Window.partitionBy("_src", "_cls")
        slices = rows.groupBy("_src", "_cls", "_slice", "_n").agg(F.count(F.lit(1)).alias("_c"))
        slices = slices.withColumn("_to", F.sum("_c").over(by.orderBy("_slice")))
        edge = slices.where((F.col("_to") >= F.col("_n")) & (F.col("_to") - F.col("_c") < F.col("_n"))).select("_src", "_cls", "_slice", (F.col("_to") - F.col("_c")).alias("_before"))
        ties = beside(rows, edge, ["_src", "_cls", "_slice"]).groupBy("_src", "_cls", "_n", "_before", "_k").agg(F.count(F.lit(1)).alias("_tied"), F.max("_size").alias("_least"))
        ties = ties.withColumn("_to", F.col("_before") + F.sum("_tied").over(by.orderBy("_k")))
        last = ties.where((F.col("_to") >= F.col("_n")) & (F.col("_to") - F.col("_tied") < F.col("_n")))
        return scratch.table(last.select("_src", "_cls", "_n", F.col("_k").alias("_cut"), (F.col("_n") - F.col("_to") + F.col("_tied")).alias("_need"), "_tied", "_least"))

    early = strata.where("_cls is not null and not _late")
    first = cut(scratch.table(_sample_sizes(early, F.lit(0.0))))
    chosen = _ranked(beside(thin, beside(first, strata.select("_src", "_cls", "_words"), ["_src", "_cls"]), ["_src", "_cls"]))
    took = chosen.where("_k < _cut").groupBy("_src").agg(F.sum("_size").alias("_took")).union(first.groupBy("_src").agg(F.sum(F.col("_need") * F.col("_least"))))
    took = took.groupBy("_src").agg(F.sum("_took").alias("_took"))
    due = early.groupBy("_src").agg((F.first("_p") * F.sum("_words")).alias("_was"))
    over = due.join(took, "_src", "left").select("_src", (F.col("_was") - F.coalesce("_took", F.lit(0))).alias("_over"))
    late = strata.where("_late").join(over, "_src", "left")
    second = cut(scratch.table(_sample_sizes(late, F.coalesce("_over", F.lit(0.0)))))
    cuts = first.union(second)

    named = {c: c for c in keep}
    for c in keep:
        while named[c] in {*RESULT, id_col} or list(named.values()).count(named[c]) > 1:
            named[c] = "doc_" + named[c]
    full = docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in own.items()], *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]).withColumn("_cls", _class(F.col("_size")))
    full = full.withColumn("_at", F.coalesce("_cls", F.lit(-1))).drop("_cls")
    beside_strata = strata.select("_src", F.coalesce("_cls", F.lit(-1)).alias("_at"), "_words", "source_size", "target", "_whole").join(cuts.withColumnRenamed("_cls", "_at"), ["_src", "_at"], "left")
    full = _ranked(beside(full, scratch.table(beside_strata), ["_src", "_at"], "left"))
    taken = F.coalesce(F.col("_k") <= F.col("_cut"), F.lit(False))
    if not cuts.where("_need < _tied").isEmpty():
        tie = F.coalesce((F.col("_k") == F.col("_cut")) & (F.col("_need") < F.col("_tied")), F.lit(False))
        order = Window.partitionBy("_src", "_at").orderBy(F.xxhash64(*[c for c in full.columns if c.startswith("_keep_")], F.lit(0)))
        full = full.where(~tie).withColumn("_nth", F.lit(None).cast("int")).union(full.where(tie).withColumn("_nth", F.row_number().over(order)))
        taken &= F.col("_nth").isNull() | (F.col("_nth") <= F.col("_need"))
    copies = F.when(F.col("_size") > 0, F.col("_whole") + taken.cast("long")).otherwise(F.lit(0)).cast("long")
    return full.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
        *[F.col(f"_keep_{i}").alias(named[c]) for i, c in enumerate(keep)],
    )


def _sql() -> str:
    def drawn(recursion: str) -> str:
        """Rows of the strata of a recursion that its samples take."""
        return f"""SELECT doc_id, source, cls, size, row_number() OVER (PARTITION BY source, cls ORDER BY CASE WHEN n * size / words >= 1 THEN 0 ELSE q / (1 + q) END) <= n AS chosen
    FROM (SELECT d.*, r.n, su.words, (u / (1 - u)) / ((r.n * size / su.words) / (1 - (r.n * size / su.words))) AS q
        FROM d JOIN su ON d.source = su.source AND d.cls = su.cls JOIN {recursion} r ON r.source = su.source AND r.i = su.i) WHERE n > 0"""

    def step(recursion: str, late: bool) -> str:
        n = "least(greatest(floor((due + carry) / (words / docs) + v), 0), docs)"
        return f"""SELECT source, i, CAST({n} AS BIGINT) AS n, due + carry - {n} * (words / docs) AS carry
        FROM (SELECT su.source, su.i, su.due, su.words, su.docs, su.v, r.carry FROM {recursion} r JOIN su ON su.source = r.source AND su.i = r.i + 1 WHERE {'' if late else 'NOT '}su.late)"""

    def u(key: str) -> str:
        return f"(CAST(CAST('0x' || substr(md5('{SEED}:' || {key}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"

    words = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"
    power = "(length(bin(size)) - 1)"
    return f"""
WITH RECURSIVE d0 AS (SELECT doc_id, coalesce('s' || source, 't') AS source, {words} AS size, {u("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')")} AS u FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN {power} * 8 + (size * 8) // CAST(pow(2, {power}) AS BIGINT) - 8 END AS cls FROM d0),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS b, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t0 AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= b THEN level END) OVER () * w, cap)) AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM t0),
c AS (SELECT source, cls, count(*) AS docs, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY source, cls),
su AS MATERIALIZED (SELECT c.*, ratio - floor(ratio) AS p, (ratio - floor(ratio)) * words AS due, {u("c.source || ':' || CAST(cls AS VARCHAR)")} AS v,
    4 * sum(words) OVER (PARTITION BY c.source ORDER BY cls) <= source_size OR cls = min(cls) OVER (PARTITION BY c.source) AS late, row_number() OVER (PARTITION BY c.source ORDER BY cls DESC) AS i
    FROM c JOIN t ON t.source = c.source),
r1 AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS carry FROM su UNION ALL {step("r1", False)}),
x1 AS MATERIALIZED ({drawn("r1")}),
o AS (SELECT su.source, max(CASE WHEN late THEN 0 ELSE i END) AS i, coalesce(max(p) * sum(CASE WHEN late THEN 0 ELSE words END), 0) - max(coalesce(took, 0)) AS carry
    FROM su LEFT JOIN (SELECT source, sum(size) AS took FROM x1 WHERE chosen GROUP BY source) k ON k.source = su.source GROUP BY su.source),
r2 AS (SELECT source, CAST(i AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(carry AS DOUBLE) AS carry FROM o UNION ALL {step("r2", True)}),
x2 AS ({drawn("(SELECT r2.* FROM r2 JOIN o ON o.source = r2.source WHERE r2.i > o.i)")}),
x AS (SELECT doc_id, source, cls, size, chosen FROM x1 UNION ALL SELECT doc_id, source, cls, size, chosen FROM x2
    UNION ALL SELECT doc_id, source, cls, size, false FROM d WHERE size = 0 OR (source, cls) IN (SELECT su.source, su.cls FROM su JOIN (SELECT * FROM r1 UNION ALL SELECT r2.* FROM r2 JOIN o ON o.source = r2.source WHERE r2.i > o.i) r ON r.source = su.source AND r.i = su.i WHERE r.n = 0))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN CAST(floor(ratio) + CASE WHEN chosen THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END AS copies,
    CASE WHEN size > 0 THEN CAST(floor(ratio) + CASE WHEN chosen THEN 1 ELSE 0 END AS BIGINT) ELSE 0 END * size AS taken
FROM x JOIN t ON t.source = x.source
"""


ORACLE_SQL = _sql()
