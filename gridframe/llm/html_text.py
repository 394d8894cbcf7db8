"""HTML extraction with a suffix array per host.

A page becomes a stream of blocks; each block is dropped by its markup, taken
as main content by its markup, or open.  The token streams of a host's pages
are concatenated, a suffix array finds the runs of ``min_run`` tokens and more
that repeat on distinct pages, and open blocks lose the tokens that such runs
cover, on pages with an article element as on others.  Content that the markup
itself names as the article is not touched by repetition, since articles quote
one another.  Where a host has fewer than ``min_pages`` distinct pages
repetition can't tell; a page with an article then keeps the article alone, any
other page all of its open blocks.

Hosts are dealt out in shards of about ``shard_pages`` pages, so no host meets
in one task.  Where a host with open blocks has more shards than one, the
distinct pages of each of its runs are counted over the whole host by 64-bit
hashes, and each shard is sent the runs of its open blocks that repeat in the
host: the texts do not depend on the number of shards.

Defined results: null html is empty and gives an empty text; null ids and urls
pass through; repeated pages of one id count as one page, so a page is never
boilerplate for its own copies.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, suffix
from .url_filter import host_of

MIN_RUN, MIN_PAGES, SHARD_PAGES, BROADCAST_HOSTS = 6, 3, 500, 50_000
FLUSH_RUNS, KNOWN_WORDS = 1_000_000, 500_000

#: a tag whose attributes hold no < or >; what does not fit is left to ``_tag_end``
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>
    |<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)
    |<[!?][^>]*>
    |(?P<text>[^<]+|<)""",
    re.X | re.S | re.I,
)
_RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style noscript template svg iframe textarea select object canvas".split()}
_SPECIAL = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([a-z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: fixed values: element names by role
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form head button dialog menu title option fieldset".split())
_MAIN = frozenset("article main".split())
_BODY = frozenset("body article main".split())
_ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead topbar cookie cookies consent gdpr notice notices "
    "banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments discussion replies reply respond disqus "
    "share sharing social related recommended subscribe subscription newsletter signup login popup modal overlay widget pagination pager skip toolbar".split()
)
_SITE_HEAD = frozenset("header masthead banner topbar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog menu menubar form alert".split())
DROPPED, OPEN, MAIN = 0, 1, 2


def _marked(attrs: str, in_main: bool) -> bool:
    """Whether attributes say that an element is not content."""
    if not attrs or attrs.isspace():
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names = set(re.split(r"[^a-z]+", value))
            if names & _WORDS - (_SITE_HEAD if in_main else frozenset()):
                return True
        elif (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Place of the > that ends a tag, outside of quotes if there is one; -1 without any.

    ``dead`` holds quotes from which on no such > was found: each is tried once
    a page, so that the whole page takes linear time.
    """
    tried, place = [], at
    while True:
        m = _SPECIAL.search(page, place)
        if m is None or m.start() in dead:
            break
        if m[0] == ">":
            return m.start()
        tried.append(m.start())
        place = page.find(m[0], m.end()) + 1
        if not place:
            break
    dead.update(tried)
    return page.find(">", at)


def _tokens(page: str) -> Iterator[tuple[str | None, str | None, bool, str]]:
    """(text, tag, closing, attributes): a text, or a tag; elements of raw text go whole."""
    at, last, dead = 0, page.rfind(">"), set()
    while at <= last:
        m = _TOKEN.match(page, at)
        at, tag, attrs = m.end(), m["tag"], m["attrs"]
        if m["text"] is not None:
            yield m["text"], None, False, ""
            continue
        if tag is None and m["tag2"] is not None:
            tag, end = m["tag2"], _tag_end(page, at, dead)
            attrs, at = page[at:end], end + 1
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"] or m["close2"])
        if tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        yield None, tag, closing, attrs or ""
    end = page.find("<!--", at)  # no tag ends from here on; a comment takes the rest
    if at < (len(page) if end < 0 else end):
        yield page[at : len(page) if end < 0 else end], None, False, ""


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of each block of a page, in order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    main = 0  # depth of main elements
    drop: str | None = None  # element being dropped, and how deep in its own kind
    depth = 0

    def flush() -> None:
        if parts:
            words = htmllib.unescape("".join(parts)).split()
            if words:
                out.append((DROPPED if drop else MAIN if main else OPEN, " ".join(words)))
            parts.clear()

    for text, tag, closing, attrs in _tokens(page):
        if tag is None:
            parts.append(text)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if drop:
            again = drop in _ENDS_ITSELF and not closing and tag == drop
            if again or (drop == "p" and tag != "p" and tag not in _INLINE) or (drop == "head" and tag in _BODY):
                flush()
                drop = None  # its end tag is left out
            elif tag == drop and not attrs.endswith("/"):
                depth += -1 if closing else 1
                if depth == 0:
                    flush()
                    drop = None
                    continue
            if drop:
                if tag not in _INLINE:
                    flush()
                continue
        if tag not in _INLINE:
            flush()
        if closing:
            if tag in _MAIN and main:
                main -= 1
        elif tag not in _VOID and not attrs.endswith("/"):
            if tag in _DROP or (tag == "header" and not main) or (tag not in ("html", "body") and tag not in _MAIN and _marked(attrs, bool(main))):
                flush()
                drop, depth = tag, 1
            elif tag in _MAIN:
                main = main + 1 if not _marked(attrs, True) else main
                if not main:
                    drop, depth = tag, 1
    flush()
    return out


def run_hashes(tokens: np.ndarray, min_run: int) -> np.ndarray:
    """A 64-bit hash of the ``min_run`` tokens from each position on, of the tokens' hashes."""
    n = max(len(tokens) - min_run + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(min_run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def token_hashes(tokens: Iterable[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each token; ``known`` keeps those of words met before."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    out = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            h = known[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)


def repeated_tokens(streams: list[list[str]], names: list, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, repeated: np.ndarray | None = None) -> list[np.ndarray]:
    """Per stream, which tokens lie in runs of ``min_run`` or more that ``min_pages`` distinct pages hold, or whose hashes are among ``repeated``."""
    flat = [t for s in streams for t in s]
    lens = np.array([len(s) for s in streams])
    ends = np.cumsum(lens)
    if not flat:
        return [np.zeros(0, bool) for _ in streams]
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(t, len(ids)) for t in flat], np.int64)
    owner = np.repeat(np.arange(len(streams)), lens)
    left = ends[owner] - np.arange(len(seq))
    sa = suffix.suffix_array(seq.astype(np.uint64), 1, min_run)
    common = suffix.common_prefixes(seq, sa, min_run)
    number: dict = {}
    page = np.array([number.setdefault(n, len(number)) for n in names])[owner]
    group = np.cumsum(common < min_run)
    whole = left[sa] >= min_run
    pairs = np.unique(np.stack([group[whole], page[sa][whole]]), axis=1) if whole.any() else np.zeros((2, 0), np.int64)
    many = np.bincount(pairs[0].astype(np.int64), minlength=int(group[-1]) + 1) >= min_pages
    hit = many[group]
    if repeated is not None and len(repeated):
        hashes = run_hashes(token_hashes(ids, {})[seq], min_run)
        ours = np.zeros(len(seq), bool)
        ours[: len(hashes)] = np.isin(hashes, repeated)
        hit |= ours[sa]
    starts = sa[whole & hit]
    mark = np.zeros(len(seq) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + min_run, -1)
    return np.split(np.cumsum(mark[:-1]) > 0, ends[:-1])


def extract(pages: list[tuple[object, str]], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, tells: bool | None = None, repeated: np.ndarray | None = None) -> list[str]:
    """Main texts of pages (id, html) of one host shard.

    ``tells``: whether the host has ``min_pages`` pages, by default whether
    these are so many; ``repeated``: hashes of runs that repeat in the host.
    """
    tells = len({i for i, _ in pages}) >= min_pages if tells is None else tells
    parsed = [blocks(h) for _, h in pages]
    streams = [[w for _, t in b for w in t.split(" ")] for b in parsed]
    covered = repeated_tokens(streams, [i for i, _ in pages], min_run, min_pages, repeated)
    out = []
    for b, hit in zip(parsed, covered, strict=True):
        has_main = any(role == MAIN for role, _ in b)
        at, kept = 0, []
        for role, text in b:
            words = text.split(" ")
            if role == MAIN:
                kept.append(text)
            elif role == OPEN and (tells or not has_main):
                kept += [w for w, h in zip(words, hit[at : at + len(words)].tolist(), strict=True) if not h]
            at += len(words)
        out.append(" ".join(kept))
    return out


def _open_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts, of columns host and html, that have an open block."""
    seen: set[str] = set()
    for batch in batches:
        new = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if host not in seen and any(role == OPEN for role, _ in blocks(page or "")):
                seen.add(host)
                new.add(host)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["host"])


def _runs_of(min_run: int, min_pages: int):
    """Runs of pages by host and part of the hashes' range.

    runs and pages are those counted: of a run ``min_pages`` pages are enough.
    wanted and salts name the shards that hold the run in an open block.
    """

    def flush(found: dict) -> pa.RecordBatch:
        rows = []
        for host, (shards, pages) in found.items():
            runs, page, salt = np.concatenate([r for r, *_ in pages]), np.repeat([p for _, p, *_ in pages], [len(r) for r, *_ in pages]), np.repeat([x for _, _, x, _ in pages], [len(r) for r, *_ in pages])
            opens = np.concatenate([o for *_, o in pages])
            wanted = np.unique(np.stack([runs[opens], salt[opens].astype(np.uint64)]), axis=1)
            counted = np.unique(np.stack([runs, page]), axis=1)
            first = np.flatnonzero(np.append(True, counted[0][1:] != counted[0][:-1])[: len(counted[0])])
            nth = np.arange(len(counted[0])) - np.repeat(first, np.diff(np.append(first, len(counted[0]))))
            counted = counted[:, nth < min_pages]
            counted = counted[:, np.argsort(counted[1], kind="stable")]  # equal pages together compress
            part, part_wanted = counted[0] % np.uint64(shards), wanted[0] % np.uint64(shards)
            by, by_wanted = np.argsort(part, kind="stable"), np.argsort(part_wanted, kind="stable")
            cuts, cuts_wanted = (np.searchsorted(x, np.arange(shards + 1, dtype=np.uint64)) for x in (part[by], part_wanted[by_wanted]))
            counted, wanted = counted[:, by], wanted[:, by_wanted]
            for k in np.unique(part).tolist():
                a, b, c, d = cuts[k], cuts[k + 1], cuts_wanted[k], cuts_wanted[k + 1]
                rows.append((host, k, *(x.tobytes() for x in (*counted[:, a:b], *wanted[:, c:d]))))
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "part", "runs", "pages", "wanted", "salts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        found: dict[str, tuple[int, list]] = {}
        n = 0
        for batch in batches:
            for host, html, page, salt, shards in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "html", "page", "salt", "shards")), strict=True):
                parsed = blocks(html or "")
                words = [w for _, t in parsed for w in t.split(" ")]
                runs = run_hashes(token_hashes(words, known), min_run)
                if not len(runs):
                    continue
                before = np.concatenate([[0], np.cumsum(np.repeat([role == OPEN for role, _ in parsed], [t.count(" ") + 1 for _, t in parsed]))])
                opens = before[min_run:] > before[:-min_run]
                found.setdefault(host, (shards, []))[1].append((runs, np.uint64(page % 2**64), salt, opens))
                n += len(runs)
                if n >= FLUSH_RUNS:
                    yield flush(found)
                    found, n = {}, 0
        if found:
            yield flush(found)

    return run


def _count(min_pages: int):
    """Of runs by host and part, per shard the wanted ones that ``min_pages`` distinct pages hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at = None

        def done() -> pa.RecordBatch:
            runs, pages, wanted, salts = (np.frombuffer(b"".join(r[i] for r in rows), np.uint64) for i in range(4))
            counted = np.unique(np.stack([runs, pages]), axis=1)[0]
            runs, times = np.unique(counted, return_counts=True)
            keep = np.isin(wanted, runs[times >= min_pages])
            pairs = np.unique(np.stack([salts[keep], wanted[keep]]), axis=1)
            to, first = np.unique(pairs[0], return_index=True)
            parts = np.split(pairs[1], first[1:]) if len(to) else []
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(to), pa.string()), pa.array(to.astype(np.int64)), pa.array([x.tobytes() for x in parts], pa.binary())], ["host", "salt", "repeated"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("host", "part", "runs", "pages", "wanted", "salts")]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                if at != (row[0], row[1]) and rows:
                    yield done()
                    rows = []
                at = (row[0], row[1])
                rows.append(row[2:])
        if rows:
            yield done()

    return run


def host_repeats(pages: DataFrame, min_run: int, min_pages: int, parts: int) -> DataFrame | None:
    """host, salt, repeated (hashes of runs) of hosts of several shards that have open blocks; None without any."""
    several = pages.where("shards > 1")
    hosts = scratch.table(several.select("host", "html").mapInArrow(_open_hosts, "host string").distinct())
    n = hosts.count()
    if not n:
        return None
    runs = several.join(F.broadcast(hosts) if n <= BROADCAST_HOSTS else hosts, "host", "left_semi").select("host", "html", F.xxhash64("page_id").alias("page"), "salt", "shards")
    runs = runs.mapInArrow(_runs_of(min_run, min_pages), "host string, part long, runs binary, pages binary, wanted binary, salts binary")
    runs = runs.repartition(parts, "host", "part").sortWithinPartitions("host", "part")
    return scratch.table(runs.mapInArrow(_count(min_pages), "host string, salt long, repeated binary"))


def _run(min_run: int, min_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        sent: list[bytes] = []
        shard = None

        def done() -> pa.RecordBatch:
            texts = extract([(r[0], r[2] or "") for r in rows], min_run, min_pages, rows[0][3], np.frombuffer(b"".join(sent), np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        for batch in batches:
            kind = batch.schema.field("page_id").type
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "tells", "host", "salt", "repeated")]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                if shard != (row[4], row[5]):
                    if rows:
                        yield done()
                    rows, sent = [], []
                shard = (row[4], row[5])
                if row[6] is None:
                    rows.append(row[:4])
                else:
                    sent.append(row[6])
        if rows:
            yield done()

    return run


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    scratch.small_batches(spark)
    thin = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    distinct = F.count_distinct(F.xxhash64("page_id"))  # null is an id as well
    sizes = scratch.table(thin.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / shard_pages).alias("shards"), (distinct >= min_pages).alias("tells"))).withColumnRenamed("host", "_host")
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_HOSTS else sizes
    salted = thin.join(side, F.col("host") == F.col("_host")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), "shards")).drop("_host")
    dealt = salted.drop("shards").withColumn("repeated", F.lit(None).cast("binary"))
    parts = scratch.partitions(spark, pages)  # of the table itself: a join has no estimate to go by
    repeats = host_repeats(salted, min_run, min_pages, parts)
    if repeats is not None:
        dealt = dealt.unionByName(repeats, allowMissingColumns=True)
    dealt = dealt.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt")
    schema = f"page_id {thin.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return dealt.mapInArrow(_run(min_run, min_pages), schema).withColumnsRenamed({"page_id": id_col, "url": url_col})
