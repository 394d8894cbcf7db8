"""URL filters: rules first, then trust and distrust over the host graph.

A rule names a host, all its subdomains, and a path prefix; the longest that
fits decides.  For other urls the host decides: personalised PageRank spreads
trust along links from hosts with allowed pages, and the same walk on the
reversed graph spreads distrust to hosts that link to blocked ones.  A host
whose share of distrust exceeds the threshold by more than the tolerance is
blocked.  Seeds of either kind sum to one.  Rounds go on until what the ranks
still lack is at most ``tolerance`` of that sum, however long the paths are.

Links are the ``href`` of ``a`` elements: with a scheme and ``//``, with ``//``
alone, or relative to a ``base`` element of another host.

Defined results: a url that is null or has no ``://`` has an empty host and
path, fits no rule and is allowed; null html has no links; repeated pages count
as often as they occur; ties between trust and distrust allow; without links
between hosts (or without seeds of a kind) ranks are those of the seeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: fixed values: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
BROADCAST_HOSTS = 50_000
#: rounds whose gains are kept as tables of their own before they are summed
UNSUMMED = 12
_LINK = r"""(?i)<a\b[^<>]*?[\s"'/]href\s*=\s*["']?([^"'\s<>]+)"""
_BASE = _LINK.replace("<a", "<base")
_FULL, _SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://", r"(?i)^[a-z][a-z0-9+.-]*:"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _decide(rules: Sequence[tuple[str, str, str]], which: int) -> Column:
    """Name (1) or verdict (0) of the longest rule that fits columns host and path."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit((verdict, host + path)[which])).otherwise(out)
    return out


def _named(link: Column) -> Column:
    """The host that a link names; empty for relative ones and other schemes."""
    return F.when(link.rlike(_FULL), host_of(link)).when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link))).otherwise(F.lit(""))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts."""
    links, base = F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1), F.coalesce(_named(F.regexp_extract(F.col(html_col), _BASE, 1)), F.lit(""))
    found = pages.select(host_of(F.col(url_col)).alias("src"), base.alias("base"), F.explode(links).alias("link"))
    relative = ~F.col("link").startswith("//") & ~F.col("link").rlike(_SCHEME)
    found = found.select("src", F.when(relative, F.col("base")).otherwise(_named(F.col("link"))).alias("dst"))
    return found.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which ranks lack at most ``tolerance`` of the seeds' sum on any graph."""
    k = 0
    while damping ** (k + 1) > tolerance:
        k += 1
    return k


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """host, rank of personalised PageRank, to ``tolerance`` of the seeds' sum or by so many ``rounds``.

    edges: src, dst, share (of src's links); seeds: host, seed.  Both may have a
    column walk: walks go on side by side.
    """
    plain = "walk" not in seeds.columns
    if plain:
        edges, seeds = edges.withColumn("walk", F.lit(0)), seeds.withColumn("walk", F.lit(0))

    def summed(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, parts).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))

    gain = scratch.table(seeds.select("walk", "host", (F.col("seed") * (1 - damping)).alias("rank")))
    least = tolerance * (seeds.agg(F.sum("seed")).first()[0] or 0.0)
    parts, done = [gain], 0
    # each round's gain is at most damping times the last one's
    while done < rounds if rounds is not None else (gain.agg(F.sum("rank")).first()[0] or 0.0) * damping > least * (1 - damping):
        sent = edges.join(gain.withColumnRenamed("host", "src"), ["walk", "src"]).groupBy("walk", F.col("dst").alias("host"))
        gain = scratch.table(sent.agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank")))
        done += 1
        parts.append(gain)
        if len(parts) > UNSUMMED:
            parts = [scratch.table(summed(parts))]
    rank = summed(parts)
    return rank.drop("walk") if plain else rank


def judge(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """id, host, path, rule, verdict, distrust (the host's share) of every page."""
    parts = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumn("rule", _decide(rules, 1)).withColumn("ruled", _decide(rules, 0))
    hosts = parts.where("host <> ''").groupBy("host")
    hosts = scratch.table(hosts.agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")))
    of = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = [hosts.where(f"{c} > 0").select(F.lit(w).alias("walk"), "host", (F.col(c) / F.lit(float(of[c] or 1))).alias("seed")) for w, c in enumerate(("good", "bad"))]
    edges = scratch.table(host_edges(pages, url_col, html_col))
    if edges.isEmpty():
        ranks = seeds[0].union(seeds[1]).withColumn("rank", F.col("seed") * (1 - damping))
    else:
        ends = [("src", "dst"), ("dst", "src")]  # distrust goes against the links
        sums = [edges.groupBy(a).agg(F.sum("n").alias("of")) for a, _ in ends]
        both = [edges.join(s, a).select(F.lit(w).alias("walk"), F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("n") / F.col("of")).alias("share")) for w, ((a, b), s) in enumerate(zip(ends, sums, strict=True))]
        ranks = propagate(scratch.table(both[0].union(both[1])), seeds[0].union(seeds[1]), damping=damping, tolerance=tolerance)
    ranks = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("walk") == w, F.col("rank"))).alias(c) for w, c in enumerate(("trust", "distrust"))])
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    hosts = scratch.table(ranks.select(F.col("host").alias("_host"), F.when(t + d > 0, d / (t + d)).otherwise(F.lit(0.0)).alias("share")))
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    share = F.coalesce("share", F.lit(0.0))
    by_host = F.when(share > threshold + tolerance, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(side, F.col("host") == F.col("_host"), "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), share.alias("distrust")
    )


def _sql() -> str:
    def case(which: int) -> str:
        arms = [
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[which]}'"
            for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        ]
        return f"CASE {' '.join(arms)} END"

    low = f"translate({{}}, '{_UP}', '{_LOW}')"
    host = "coalesce(" + low.format("regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def named(link: str) -> str:
        return f"CASE WHEN regexp_matches({link}, '{_FULL}') THEN {host.format(u=link)} WHEN starts_with({link}, '//') THEN {host.format(u="'x:' || " + link)} ELSE '' END"

    text = f"""
WITH RECURSIVE p AS (SELECT page_id, html, {host.format(u="url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {case(1)} AS rule, {case(0)} AS ruled FROM p),
s AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad FROM r WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, coalesce(regexp_extract(html, '{quoted(_BASE)}', 1), '') AS base, unnest(regexp_extract_all(html, '{quoted(_LINK)}', 1)) AS u FROM p),
n AS (SELECT src, CASE WHEN starts_with(u, '//') OR regexp_matches(u, '{_SCHEME}') THEN {named("u")} ELSE {named("base")} END AS dst FROM l),
e AS (SELECT src, dst, count(*) AS n FROM n WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
b AS MATERIALIZED (SELECT 0 AS walk, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
g AS (SELECT 0 AS walk, host, good / sum(good) OVER () AS seed FROM s WHERE good > 0 UNION ALL SELECT 1, host, bad / sum(bad) OVER () FROM s WHERE bad > 0),
r1 AS (SELECT walk, 0 AS k, host, seed * (1 - {DAMPING}::DOUBLE) AS rank FROM g
    UNION ALL SELECT r1.walk, k + 1, dst, sum(rank * share) * {DAMPING}::DOUBLE FROM r1 JOIN b ON b.walk = r1.walk AND b.src = r1.host WHERE k < {rounds_for(DAMPING, TOLERANCE)} GROUP BY r1.walk, k, dst),
h AS (SELECT host, coalesce(sum(rank) FILTER (WHERE walk = 0), 0) AS t, coalesce(sum(rank) FILTER (WHERE walk = 1), 0) AS d FROM r1 GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(CASE WHEN t + d > 0 THEN d / (t + d) END, 0) > {THRESHOLD} + {TOLERANCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN h ON r.host = h.host
"""
    return text


ORACLE_SQL = _sql()
