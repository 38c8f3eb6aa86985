"""Secrets in texts, found by one automaton for all rules.

The rules' regular expressions are compiled together: to position sets, by
subset construction over classes of bytes that no rule tells apart, then
minimised into one transition array.  A text is scanned once, byte by byte, by
all rules.  Bytes that lead every state back to the start cut a text into lanes
that cannot share a match; a task steps thousands of lanes at once through the
array.  Lanes in which a rule's accepting state was reached go to that rule's
exact expression, which gives the leftmost non-overlapping spans.

Null and empty texts hold no secret; rows are treated one by one, so repeated
rows and ties need no care; extra columns are ignored (``redacted`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

LANE, CHUNK = 512, 4 << 20


@dataclass(frozen=True)
class Rule:
    """``find`` gives the matches, of which those with at least ``least`` bytes
    in ``group`` stay; ``scan`` must match inside every match that stays (a
    telling part will do, as long counts of several rules multiply states)."""

    kind: str
    find: str
    scan: str
    group: int = 0
    least: int = 0


_KEYWORD = r"(password|passwd|secret|token|api_?key)"
_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"(?i:{_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?"
BASE = (
    Rule("assign", rf"{_ASSIGN}({_VALUE}+)", rf"{_ASSIGN}{_VALUE}{{8}}", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32}", 0, 32),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{2}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"\.eyJ[A-Za-z0-9_-]{2}"),
)
RULES = BASE + ADDED


class _Positions:
    """Follow sets of the byte positions of an expression."""

    def __init__(self) -> None:
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def leaf(self, allowed: frozenset[int]) -> tuple[set[int], set[int], bool]:
        self.bytes.append(allowed)
        self.follow.append(set())
        return {len(self.bytes) - 1}, {len(self.bytes) - 1}, False

    def then(self, a, b):
        for p in a[1]:
            self.follow[p] |= b[0]
        return a[0] | (b[0] if a[2] else set()), b[1] | (a[1] if b[2] else set()), a[2] and b[2]

    def any_of(self, parts):
        return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)

    def build(self, tree, fold: bool):
        out = (set(), set(), True)
        for op, arg in tree:
            out = self.then(out, self.node(op, arg, fold))
        return out

    def node(self, op, arg, fold: bool):
        if op is C.LITERAL:
            return self.leaf(_folded({arg}, fold))
        if op is C.IN:
            allowed: set[int] = set()
            for kind, x in arg:
                allowed |= {x} if kind is C.LITERAL else set(range(x[0], x[1] + 1))
            return self.leaf(_folded(allowed, fold))
        if op is C.SUBPATTERN:
            return self.build(arg[3], (fold or bool(arg[1] & re.I)))
        if op is C.BRANCH:
            return self.any_of([self.build(x, fold) for x in arg[1]])
        if op is C.MAX_REPEAT:
            low, high, inner = arg
            out = (set(), set(), True)
            for _ in range(low):
                out = self.then(out, self.build(inner, fold))
            if high is C.MAXREPEAT:
                loop = self.build(inner, fold)
                for p in loop[1]:
                    self.follow[p] |= loop[0]
                return self.then(out, (loop[0], loop[1], True))
            for _ in range(high - low):
                one = self.build(inner, fold)
                out = self.then(out, (one[0], one[1], True))
            return out
        raise ValueError(f"a rule uses {op}, which the automaton does not know")


def _folded(allowed: set[int], fold: bool) -> frozenset[int]:
    if fold:
        allowed = allowed | {b ^ 32 for b in allowed if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(allowed)


@dataclass(frozen=True)
class Automaton:
    byte_class: np.ndarray  # byte -> class
    next_state: np.ndarray  # state * classes + class -> state
    accepts: np.ndarray  # state -> bit mask of rules
    resets: np.ndarray  # byte -> every state goes to the start

    @property
    def classes(self) -> int:
        return int(self.byte_class.max()) + 1


@lru_cache(maxsize=8)
def compile_rules(patterns: tuple[str, ...]) -> Automaton:
    """The minimal automaton that finds any of ``patterns`` anywhere in bytes."""
    pos = _Positions()
    first: set[int] = set()
    final: dict[int, int] = {}
    for i, text in enumerate(patterns):
        f, last, empty = pos.build(parser.parse(text.encode()), False)
        if empty:
            raise ValueError(f"{text!r} matches the empty string")
        first |= f
        for p in last:
            final[p] = final.get(p, 0) | 1 << i
    # bytes that no position tells apart
    table = np.zeros((256, len(pos.bytes)), bool)
    for p, allowed in enumerate(pos.bytes):
        table[sorted(allowed), p] = True
    _, byte_class = np.unique(table, axis=0, return_inverse=True)
    byte_class = byte_class.ravel().astype(np.uint8)
    by_class = [frozenset(np.flatnonzero(table[np.argmax(byte_class == c)]).tolist()) for c in range(byte_class.max() + 1)]
    # subset construction; the start stays in every set, as a match may begin anywhere
    follow = [frozenset(x) for x in pos.follow]
    start: frozenset[int] = frozenset()
    number, todo, rows = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        reach = first.union(*(follow[p] for p in state))
        row = []
        for allowed in by_class:
            to = frozenset(reach & allowed)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    trans = np.array(rows)
    mask = np.zeros(len(number), np.int64)
    for s, i in number.items():
        for p in s:
            mask[i] |= final.get(p, 0)
    # minimisation: split by what is accepted, then by where each class leads
    block = np.unique(mask, return_inverse=True)[1].ravel()
    while True:
        fresh = np.unique(np.column_stack([block, block[trans]]), axis=0, return_inverse=True)[1].ravel()
        if fresh.max() == block.max():
            break
        block = fresh
    order = np.unique(block, return_index=True)[1]
    rank = np.argsort(np.argsort(order))  # the start state becomes 0
    block, order = rank[block], np.sort(order)
    small = block[trans[order]]
    resets = (small == block[0]).all(axis=0)[byte_class]
    return Automaton(byte_class, small.astype(np.int32).ravel(), mask[order].astype(np.int32), resets)


def lanes_hit(auto: Automaton, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, rules) of the lanes of a run of documents in which a rule accepts."""
    cuts = [off]
    free = np.flatnonzero(auto.resets[buf])
    if len(free):
        at = np.searchsorted(free, np.arange(LANE, len(buf), LANE))
        cuts.append(free[at[at < len(free)]] + 1)
    cuts = np.unique(np.concatenate(cuts))
    start, end = cuts[:-1], cuts[1:]
    order = np.argsort(start - end, kind="stable")
    start, end = start[order], end[order]
    size = end - start
    code = auto.byte_class[buf]
    classes = auto.classes
    state = np.zeros(len(start), np.int32)
    hit = np.zeros(len(start), np.int32)
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for step, n in enumerate(active.tolist()):
        s = auto.next_state[state[:n] * classes + code[start[:n] + step]]
        state[:n] = s
        hit[:n] |= auto.accepts[s]
    found = np.flatnonzero(hit)
    found = found[np.argsort(start[found])]
    return start[found], end[found], hit[found]


def _exact(rules: tuple[Rule, ...]) -> list[re.Pattern[bytes]]:
    return [re.compile(r.find.encode()) for r in rules]


def spans_of(auto: Automaton, rules: tuple[Rule, ...], buf: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Per document with any: (start, rule, end) in code points, sorted."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    exact = _exact(rules)
    for a, b, hit in zip(*lanes_hit(auto, buf, off), strict=True):
        lane = buf[a:b].tobytes()
        doc = int(np.searchsorted(off, a, side="right")) - 1
        lead = None
        for i, (rule, rx) in enumerate(zip(rules, exact, strict=True)):
            if not hit >> i & 1:
                continue
            for m in rx.finditer(lane):
                x, y = m.span(rule.group)
                if y - x < rule.least:
                    continue
                if lead is None:
                    lead = int(np.count_nonzero((buf[off[doc] : a] & 0xC0) != 0x80))
                points = lambda n: lead + len(lane[:n].decode(errors="ignore")) if n else lead  # noqa: B023, E731
                out.setdefault(doc, []).append((points(m.start()), i, points(m.end())))
    for spans in out.values():
        spans.sort()
    return out


def _scan(rules: tuple[Rule, ...], make: Callable) -> Callable:
    auto = compile_rules(tuple(r.scan for r in rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in B.doc_chunks(batch.column("text"), CHUNK):
                yield make(batch.slice(lo, hi - lo), spans_of(auto, rules, buf, off))

    return run


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row."""
    base = {r.kind for r in BASE}
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def make(batch: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        cols: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for i in range(batch.num_rows):
            spans = [(rules[k].kind, s, e) for s, k, e in found.get(i, ())]
            kinds = [k for k, _, _ in spans]
            for k in ("assign", "access", "hex"):
                cols[f"n_{k}"].append(kinds.count(k))
            joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in base)
            cols["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            cols["spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True))], names=["doc_id", *cols])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan(rules, make), schema)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; all columns
    stay, and texts without a secret (null ones too) are unchanged."""

    def make(batch: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        body = batch.column("text")
        if found:
            values = body.to_pylist()
            for i, spans in found.items():
                old, new, at = values[i], [], 0
                for s, k, e in spans:
                    if s >= at:
                        new += [old[at:s], f"[{rules[k].kind}]"]
                    at = max(at, e)
                values[i] = "".join(new) + old[at:]
            body = pa.array(values, body.type)
        return batch.set_column(batch.schema.get_field_index("text"), "text", body)

    order = docs.columns
    scanned = docs.withColumnRenamed(text, "text") if text != "text" else docs
    out = scanned.mapInArrow(_scan(rules, make), scanned.schema)
    return (out.withColumnRenamed("text", text) if text != "text" else out).select(*order)


def _matches_sql(kind: str, regex: str, keep: str) -> str:
    """Spans of the matches of ``regex``, by adding up what lies between them."""
    return f"""
    SELECT rid, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT rid, m, i, list_sum(list_transform(between_[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS start
      FROM (SELECT rid, found, between_, unnest(found) AS m, generate_subscripts(found, 1) AS i FROM (
        SELECT rid, regexp_extract_all(body, '{regex}') AS found, regexp_split_to_array(body, '{regex}') AS between_ FROM d WHERE regexp_matches(body, '{regex}')))
    ) WHERE {keep}"""


def oracle_sql() -> str:
    """The report in DuckDB."""
    # DuckDB's (?i) folds letters beyond ASCII too
    cased = lambda r: re.sub(r"\(\?i:(.*?\))\)", lambda m: re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", m[1]), r)
    q = lambda r: cased(r).replace("'", "''").replace('\\"', '"')
    value = f"length(regexp_extract(m, '{q(BASE[0].find)}', 2)) >= 8"
    parts = [_matches_sql("assign", q(BASE[0].find), value)]
    parts += [_matches_sql(r.kind, q(r.find), f"length(m) >= {r.least}") for r in RULES[1:]]
    order = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(RULES)) + " END"
    joined = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
    s AS (SELECT *, {order} AS k FROM ({' UNION ALL '.join(parts)}))
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      sha256(coalesce({joined} FILTER ({base}), '')) AS base_sha256, coalesce({joined} FILTER (kind IS NOT NULL), '') AS spans
    FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""
