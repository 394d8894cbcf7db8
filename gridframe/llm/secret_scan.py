"""Secret scans through a trigram index.

Of each rule's regular expression a Boolean query over trigrams is derived from
its parse tree: every match of the expression satisfies the query.  A slice of
texts is indexed by the trigrams that the queries name, postings are
intersected and united, and only the candidate texts are verified with the
expression.  A rule whose query holds no mandatory trigram scans all texts.

Defined results: null text counts as empty and has no spans; matches are
leftmost and do not overlap within a kind, those that fail the rule's length
are dropped; offsets are code points, ends exclusive; repeated rows are each
scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sc
from re import _parser as sp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as tx

CHUNK_BYTES = 1 << 20
MAX_STRINGS, MAX_CLASS = 64, 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, group whose length counts, least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, (re.I if self.either_case else 0) | re.A)


#: fixed values: the base rules, then those that the method adds
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x00-\x20:@/]{3,}@"),
)

# A query is True (nothing mandatory), a trigram (bytes), or ("and" | "or", parts).


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts: list) -> object:
    if not parts or any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """What a text holds that contains one of the strings."""
    each = []
    for s in strings:
        b = s.encode()
        each.append(_all([b[i : i + 3] for i in range(len(b) - 2)]))
    return _any(each)


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sc.LITERAL:
            out.add(chr(arg).lower())
        elif op is sc.RANGE and arg[1] - arg[0] < 64:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > MAX_CLASS:
            return None
    return out


def _walk(seq) -> tuple[set[str] | None, object]:
    """(all strings that the sequence can match, or None; query of every match)."""
    known: set[str] = {""}
    exact, queries = True, []

    def cut() -> None:
        nonlocal known, exact
        queries.append(_of_strings(known))
        known, exact = {""}, False

    def add(strings: set[str] | None, query: object) -> None:
        nonlocal known
        if strings is None:
            cut()
            queries.append(query)
        elif len(known) * len(strings) > MAX_STRINGS:
            cut()
            known = set(strings)
            if len(known) > MAX_STRINGS:
                cut()
        else:
            known = {a + b for a in known for b in strings}

    for op, arg in seq:
        if op is sc.LITERAL:
            add({chr(arg).lower()}, True)
        elif op is sc.IN:
            add(_class(arg), True)
        elif op is sc.SUBPATTERN:
            add(*_walk(arg[3]))
        elif op is sc.BRANCH:
            each = [_walk(b) for b in arg[1]]
            whole = None if any(s is None for s, _ in each) else set().union(*[s for s, _ in each])
            add(whole, _any([q if s is None else _of_strings(s) for s, q in each]))
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, sub = arg
            strings, query = _walk(sub)
            if strings is not None and low == 0 and high == 1:
                add(strings | {""}, True)
            elif low == 0:
                cut()
            else:
                for _ in range(min(low, 4)):
                    add(strings, query)
                if low != high or low > 4:
                    cut()
        elif op is sc.AT:
            continue
        else:
            add(None, True)
    return (known if exact else None), _all([*queries, _of_strings(known)])


def trigram_query(pattern: str) -> object:
    """Boolean query over ASCII-lower-case trigrams that every match satisfies."""
    strings, query = _walk(sp.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*[_trigrams(q) for q in query[1]])


class Index:
    """Postings, by text of a slice, of the trigrams that the rules' queries name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*[_trigrams(q) for q in self.queries]))
        self.row = {g: i for i, g in enumerate(self.grams)}
        self.code = np.zeros(1 << 24, np.uint16)
        for g, i in self.row.items():
            self.code[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def candidates(self, raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """For each rule the indices of the texts to verify."""
        n = len(offs) - 1
        postings = np.zeros((len(self.grams), n), bool)
        if len(raw) >= 3:
            low = tx.LOWER[raw].astype(np.uint32)
            at = self.code[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            where = np.flatnonzero(at)
            postings[at[where] - 1, np.searchsorted(offs, where, "right") - 1] = True

        def holds(q) -> np.ndarray:
            if q is True:
                return np.ones(n, bool)
            if isinstance(q, bytes):
                return postings[self.row[q]]
            each = [holds(x) for x in q[1]]
            return np.logical_and.reduce(each) if q[0] == "and" else np.logical_or.reduce(each)

        return [np.flatnonzero(holds(q)) for q in self.queries]


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32())]))


def _run(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            for part in tx.slices(batch, "text", CHUNK_BYTES):
                i = part.schema.get_field_index("text")
                column = part.column(i)
                texts: dict[int, str] = {}
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for k, docs in enumerate(index.candidates(*tx.buffers(column))):
                    rule, rx = rules[k], compiled[k]
                    for d in docs.tolist():
                        if d not in texts:
                            texts[d] = column[d].as_py() or ""
                        for m in rx.finditer(texts[d]):
                            s, e = m.span(rule.group)
                            if e - s >= rule.least:
                                spans[d].append((m.start(), k, m.end(), s))
                rows = [[{"kind": rules[k].kind, "start": s, "end": e, "from": f} for s, k, e, f in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in range(part.num_columns)], pa.array(rows, _KIND)], [*part.schema.names, "spans"])

    return run


def find_spans(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns (as ``k0`` ..), ``text`` and ``spans`` by start, then kind as listed.

    A span is kind, start, end, and the offset from which the secret itself runs.
    """
    scratch.small_batches(docs.sparkSession)
    frame = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema], "spans array<struct<kind:string,start:int,end:int,`from`:int>>"])
    return frame.mapInArrow(_run(rules), schema)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and spans of every document."""
    return find_spans(docs, text_col=text_col, keep=(id_col,), rules=rules).select(F.col("k0").alias(id_col), "spans")


def redact(text, spans, mark: str = "[REDACTED]"):
    """Column expression: the text with every secret replaced by ``mark``.

    Overlapping spans are replaced once.
    """
    state = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["from"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["from"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, state).otherwise(text)


def _sql() -> str:
    """Match positions from the pieces between matches; letters in either case spelled out."""

    def pattern(rule: Rule) -> str:
        if not rule.either_case:
            return rule.pattern
        head, rest = rule.pattern.split(")", 1)
        return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", head) + ")" + rest

    def arm(k: int, rule: Rule) -> str:
        rx = pattern(rule).replace("'", "''")
        least = f"WHERE len(regexp_extract(m, '{rx}', {rule.group})) >= {rule.least}"
        return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, CAST(s AS BIGINT) AS s, CAST(s + len(m) AS BIGINT) AS e FROM (
  SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS s FROM (
    SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{rx}') AS ms, string_split_regex(t, '{rx}') AS ps FROM d WHERE regexp_matches(t, '{rx}')))) {least}"""

    arms = "\nUNION ALL\n".join(arm(k, r) for k, r in enumerate(RULES))
    kinds = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in kinds)
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({arms}),
a AS (SELECT doc_id, {counts}, coalesce(string_agg({one}, ',' ORDER BY s, k) FILTER (WHERE base), '') AS base, string_agg({one}, ',' ORDER BY s, k) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


ORACLE_SQL = _sql()
