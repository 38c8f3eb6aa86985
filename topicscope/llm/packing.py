"""Packing token sequences into windows by minimum bin slack.

Every document is encoded and closed by one end id.  Its first tokens fill whole
windows of ``CAPACITY``; what remains (shorter than a window) is one piece.  How
many remaining pieces there are of each length is counted over the whole corpus:
at most ``CAPACITY - 1`` counts, however large the input.  On these counts

* the longest remaining piece opens a window, and a subset-sum over bitsets (one
  bit per fill, lengths repeated by doubling up to their counts) finds the multiset
  of lengths that comes closest to the capacity; walking the bitsets backwards gives
  how many pieces of each length it takes;
* the multiset is used for as many windows as the counts allow, so the number of
  rules depends on the capacity and not on the corpus;
* a window that no multiset fills exactly takes the first tokens of one more piece,
  whose rest goes back into the counts as a shorter piece;
* the last window, with nothing left to fill it, is cut into sequences of power of
  two lengths, which need no padding.

A piece finds its window by its rank among the pieces of its length: Spark counts
the ranks before each partition of the encoded table and adds the rank within it.
So no group is ever collected, and one length holding a third of all rows is spread
like any other.  Sequences hold no padding at all.

Null and empty texts give the end id alone.  A text of any length is cut into
windows.  Equal rows are packed one by one; rows need no key, and other columns are
not read.  An empty table gives no rows.  The string of a special token inside a text
becomes its id, as in the library's own call with ``add_special_tokens=False``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tokens
from ._bytes import stage

CAPACITY = 2048
END_ID = 1
_RANK_BITS = 48
_FLUSH_BYTES = 1 << 23


# ---------------------------------------------------------------- the plan

def closest_multiset(count: dict[int, int], target: int) -> dict[int, int]:
    """Lengths, with how often each is taken (at most ``count``), whose sum is the
    largest one not over ``target``.  Bitset subset-sum, longest lengths first; it
    ends as soon as the target itself is reached."""
    keep = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, c in count.items() if c > 0 and x <= target), reverse=True):
        left, k = min(count[length], target // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & keep
            left, k = left - k, 2 * k
        if reach >> target:
            break
    fill, took = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> fill & 1:
            took[length] = took.get(length, 0) + k
            fill -= k * length
    return took


@dataclass(frozen=True)
class Plan:
    """Rules by (length, first rank).  A rule's ``j``-th piece gives its first
    ``head`` tokens to sequence ``seq + j // per`` at ``offset + (j % per) * head``;
    what is left of it is the piece of the remaining length at rank ``tail + j``."""

    length: np.ndarray
    first: np.ndarray
    head: np.ndarray
    per: np.ndarray
    seq: np.ndarray
    offset: np.ndarray
    tail: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the piece, length, sequence, offset) of every part of the
        pieces given by length and rank, parts of one piece in order of start."""
        key = (self.length << _RANK_BITS) | self.first
        row, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        parts: list[tuple[np.ndarray, ...]] = [(row[:0],) * 5]
        while len(row):
            i = np.searchsorted(key, (length << _RANK_BITS) | rank, side="right") - 1
            j, head, per = rank - self.first[i], self.head[i], self.per[i]
            parts.append((row, start, head, self.seq[i] + j // per, self.offset[i] + (j % per) * head))
            more = head < length
            row, start, length, rank = row[more], (start + head)[more], (length - head)[more], (self.tail[i] + j)[more]
        out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((out[1], out[0]))
        return tuple(c[order] for c in out)


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The rules that pack ``counts[length]`` pieces of each length under ``capacity``."""
    left = {x: c for x, c in counts.items() if c > 0}
    if any(not 0 < x < capacity for x in left):
        raise ValueError(f"remaining lengths must be between 1 and {capacity - 1}")
    made = dict(left)
    rules: list[tuple[int, ...]] = []
    seq = 0

    def take(length: int, n: int, head: int, per: int, at: int, offset: int) -> None:
        rest, tail = length - head, 0
        if rest:
            tail = made.get(rest, 0)
            made[rest] = tail + n
            left[rest] = left.get(rest, 0) + n
        rules.append((length, made[length] - left[length], head, per, at, offset, tail))
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        top = max(left)
        rest = left | {top: left[top] - 1}
        took = closest_multiset(rest, capacity - top)
        took[top] = took.get(top, 0) + 1
        fill = sum(x * n for x, n in took.items())
        slack = capacity - fill
        after = {x: c - took.get(x, 0) for x, c in left.items() if c > took.get(x, 0)}
        if slack and not after:
            break
        cut = max(after) if slack else 0
        uses = took | ({cut: took.get(cut, 0) + 1} if slack else {})
        times = min(left[x] // n for x, n in uses.items())
        offset = 0
        for x in sorted(took, reverse=True):
            take(x, times * took[x], x, took[x], seq, offset)
            offset += x * took[x]
        if slack:
            take(cut, times, slack, 1, seq, offset)
        seq += times
    # fewer tokens than a window: sequences of the powers of two that they add up to
    room, offset, tokens = 0, 0, sum(x * c for x, c in left.items())
    while left:
        if not room:
            room, offset = 1 << (tokens.bit_length() - 1), 0
            tokens -= room
            seq += 1
        x = max(left)
        head = min(x, room)
        take(x, 1, head, 1, seq - 1, offset)
        room, offset = room - head, offset + head
    columns = np.array(sorted(rules), np.int64).reshape(-1, 7).T
    return Plan(*columns, sequences=seq)


# ---------------------------------------------------------------- Spark

_ENCODED = "part int, row long, doc_id long, n long, rest int, rank long, fulls long, crcs array<long>, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, row long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _encoder(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _tokens.byte_level_encoder(path, True)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity, np.int64)
        row, fulls = 0, 0
        names = [c.split()[0] for c in _ENCODED.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            out, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                full, rest = divmod(len(ids), capacity)
                crcs = [_crc(ids[i : i + capacity]) for i in range(0, len(ids), capacity)]
                remaining = ids[full * capacity :].tobytes()
                out.append((part, row, doc_id.as_py(), len(ids), rest, int(seen[rest]), fulls, crcs, remaining))
                seen[rest] += 1
                row, fulls, size = row + 1, fulls + full, size + len(remaining)
                if size > _FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _placer(plan: Plan, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n) for n in batch.schema.names}
            n, rest, fulls = (col[c].to_numpy() for c in ("n", "rest", "full_rank"))
            crcs = col["crcs"]
            crc_off, crc = crcs.offsets.to_numpy(), crcs.values.to_numpy()
            full = n // capacity
            i = np.repeat(np.arange(len(n)), full)
            k = np.arange(len(i)) - np.repeat(np.cumsum(full) - full, full)
            open_ = np.flatnonzero(rest > 0)
            r, start, length, seq, offset = plan.place(rest[open_].astype(np.int64), col["rest_rank"].to_numpy()[open_])
            r = open_[r]
            whole = length == rest[r]
            row = np.concatenate([i, r])
            sums = np.concatenate([crc[crc_off[i] + k], crc[crc_off[r] + full[r]]])
            yield pa.RecordBatch.from_arrays(
                [
                    col["doc_id"].take(pa.array(row)),
                    pa.array(np.concatenate([k * capacity, full[r] * capacity + start])),
                    pa.array(np.concatenate([np.full(len(i), capacity), length])),
                    pa.array(sums, mask=np.concatenate([np.zeros(len(i), bool), ~whole])),
                    pa.array(n[row]),
                    pa.array(np.concatenate([plan.sequences + fulls[i] + k, seq])),
                    pa.array(np.concatenate([np.zeros(len(i), np.int64), offset])),
                    col["part"].take(pa.array(row)),
                    col["row"].take(pa.array(row)),
                ],
                [c.split()[0] for c in _PIECES.split(", ")],
            )

    return run


def _cut_sums(capacity: int):
    """Checksums of the pieces that are parts of a remaining piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length = (batch.column(c).to_numpy() for c in ("start", "length"))
            sums = [
                _crc(np.frombuffer(ids.as_buffer(), "<u4")[s % capacity : s % capacity + k])
                for ids, s, k in zip(batch.column("ids"), start, length, strict=True)
            ]
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in keep], keep)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.  A document's pieces cover its ids once; a sequence's pieces are gapless
    from offset 0 and add up to ``capacity`` or to a smaller power of two."""
    path = tokenizer_path or _tokens.default_path("byte_bpe_50k.json")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = stage(texts.mapInArrow(_encoder(path, capacity, end_id), _ENCODED), "packing-encoded")
    # length 0 stands for the whole windows, so that these are numbered in the same way
    held = encoded.filter("rest > 0").groupBy("part", "rest").agg((F.max("rank") + 1).alias("c")).unionByName(
        encoded.groupBy("part").agg(F.max(F.col("fulls") + F.expr(f"n div {capacity}")).alias("c")).withColumn("rest", F.lit(0))
    )
    held = stage(held, "packing-counts")
    counts = {r.rest: r.c for r in held.filter("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # under `capacity` rows
    plan = minimum_bin_slack(counts, capacity)
    before = F.sum("c").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("part", "rest", F.coalesce(before, F.lit(0)).alias("before"))
    rows = encoded.drop("ids").join(base.filter("rest = 0").select("part", F.col("before").alias("fulls_before")), "part")
    rows = rows.join(base.filter("rest > 0").select("part", "rest", F.col("before").alias("rank_before")), ["part", "rest"], "left")
    rows = rows.select(
        "part", "row", "doc_id", "n", "rest", "crcs",
        (F.coalesce("rank_before", F.lit(0)) + F.col("rank")).alias("rest_rank"),
        (F.col("fulls_before") + F.col("fulls")).alias("full_rank"),
    )
    pieces = stage(rows.mapInArrow(_placer(plan, capacity), _PIECES), "packing-pieces")
    # few as a rule; written first, so that a small file is known to be one when the join is planned
    cut = stage(pieces.filter("ids_crc32 is null"), "packing-cut").join(encoded.select("part", "row", "ids"), ["part", "row"])
    cut = cut.select(*pieces.columns, "ids").mapInArrow(_cut_sums(capacity), _PIECES)
    return pieces.filter("ids_crc32 is not null").unionByName(cut).drop("part", "row")
