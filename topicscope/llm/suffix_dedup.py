"""Removal of long byte strings that occur more than once in the corpus.

A byte goes when some ``length``-byte string that covers it also starts anywhere
else, in the same document or another.  The method is threshold-bounded interval
expansion over a Burrows-Wheeler transform, cut into independent intervals:

1. Every ``length``-byte window names one anchor inside it, chosen by content
   (least hash among its ``gram``-byte strings), so equal windows name the same
   string at the same place.  The occurrences of one anchor string are one
   interval of the corpus' suffix array; only their hashes are shuffled.
2. Intervals of a single occurrence end there.  Occurrences whose whole context
   (all windows that chose them) is the same elsewhere are settled by count.
3. The other contexts are sorted into suffix order inside their interval, and
   adjacent common prefixes are taken.  Breadth-first backward extension then
   splits every interval by its BWT character, one more byte to the left at a
   time, so common prefixes come by increasing length, and stops at ``length``.
   Intervals of one occurrence are dropped on the way.

An interval with more than ``cap`` contexts is first refined in Spark: its
windows are halved, and each half gets the longer string that all its windows
share, until it is small or one window is left, which counting settles.  So no
task holds an unbounded interval, and nothing is dropped.  Rows of frequent
strings are matched with their counts by a broadcast of bounded size.

Null and empty texts have no bytes and nothing to remove; repeated rows repeat
each other's strings, so both lose them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

LENGTH = 400
GRAM = 200
CAP = 2000
FREQUENT_ROWS = 1000
MAX_FREQUENT = 10_000
BLOCK_ROWS = 8192

_ANCHORS = "rid long, t long, pos int, jlo int, jhi int, h long, c long"
_CONTEXTS = "rid long, t long, pos int, jlo int, jhi int, h long, ctx binary"


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, t, text): the key of a row is its id and the hash of its text, so
    repeated rows share a key and get equal results."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("rid"), F.xxhash64(body).alias("t"), body.alias("text"))


def _anchor_batches(length: int, gram: int):
    w = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, t = batch.column("rid").to_numpy(), batch.column("t").to_numpy()
            for lo, _, buf, off in B.doc_chunks(batch.column("text")):
                n = len(buf)
                if n < length:
                    continue
                prefix = B.prefix_sums(B.byte_values()[buf])
                at = np.arange(n - gram + 1)
                hashes = B.span_hash(prefix, at, at + gram)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                ok = doc[: n - length + 1] == doc[length - 1 :]
                v = np.maximum((hashes >> B.U64(32)).astype(np.uint32), 1)
                pos, first, last = B.window_anchors(v, w, 0, ok)
                if not len(pos):
                    continue
                row = doc[pos]
                c = B.mix(B.span_hash(prefix, first, last + length) + (pos - first).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[lo + row]), pa.array(t[lo + row]), pa.array((pos - off[row]).astype(np.int32)), pa.array((pos - last).astype(np.int32)), pa.array((pos - first).astype(np.int32)), pa.array(hashes[pos].view(np.int64)), pa.array(c.view(np.int64))],
                    names=["rid", "t", "pos", "jlo", "jhi", "h", "c"],
                )

    return run


def _context_batches(length: int):
    """Bytes of the windows of the wanted anchors, cut from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            counts = np.diff(want.offsets.to_numpy())
            flat = want.flatten()
            pos, jlo, jhi = (flat.field(k).to_numpy() for k in ("pos", "jlo", "jhi"))
            rows = np.repeat(np.arange(batch.num_rows), counts)
            buf, off = B.text_buffer(batch.column("text"))
            rid, t, h = batch.column("rid").to_numpy(), batch.column("t").to_numpy(), flat.field("h").to_numpy()
            start = off[rows] + pos - jhi
            end = off[rows] + pos - jlo + length
            for i in range(0, len(rows), BLOCK_ROWS):
                k = slice(i, i + BLOCK_ROWS)
                ctx = [buf[a:b].tobytes() for a, b in zip(start[k], end[k], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rid[rows[k]]), pa.array(t[rows[k]]), pa.array(pos[k]), pa.array(jlo[k]), pa.array(jhi[k]), pa.array(h[k]), pa.array(ctx, pa.binary())], names=["rid", "t", "pos", "jlo", "jhi", "h", "ctx"])

    return run


def _adjacent_prefixes(right: np.ndarray, group: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; -1 at a group's start."""
    out = np.full(len(group), -1, np.int64)
    if len(group) > 1:
        differ = right[1:] != right[:-1]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(n, np.minimum(size[1:], size[:-1])), -1)
    return out


def repeated_windows(group: np.ndarray, ctx: list[bytes], jlo: np.ndarray, jhi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts aligned on their group's anchor: the least and largest ``j``
    (bytes left of the anchor) of a window that another context also holds; the
    least is above the largest where none is."""
    m = len(ctx)
    left, right = int(jhi.max()), int(length - jlo.min())
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    size = np.fromiter(map(len, ctx), np.int64, m)
    base = np.cumsum(size) - size
    reach = np.minimum(size - jhi, right)
    cols = np.arange(right)
    # UTF-8 has no byte 255, so bytes move up by one and 0 marks the end
    body = np.where(cols < reach[:, None], flat[np.minimum((base + jhi)[:, None] + cols, len(flat) - 1)] + 1, 0).astype(np.uint8)
    # suffix order inside each interval
    order = np.argsort(np.ascontiguousarray(body).view(f"S{right}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    lcp = _adjacent_prefixes(body[order], group[order], reach[order])
    low, high = np.full(m, length + 1), np.full(m, -1)
    interval = np.cumsum(lcp < 0)
    for j in range(left + 1):
        if not len(order):
            break
        # a window of j bytes to the left needs length - j bytes to the right
        near = np.maximum(lcp, np.append(lcp[1:], -1))
        mine = order[(near >= length - j) & (jlo[order] <= j)]
        low[mine] = np.minimum(low[mine], j)
        high[mine] = np.maximum(high[mine], j)
        # backward extension: occurrences whose windows end here leave, the rest
        # split by the character before them
        alive = np.flatnonzero(jhi[order] > j)
        if not len(alive):
            break
        char = flat[(base + jhi)[order[alive]] - 1 - j]
        part = interval[alive].astype(np.int64) * 256 + char
        if len(alive) < len(order) or (part[1:] != part[:-1])[interval[alive][1:] == interval[alive][:-1]].any():
            sort = np.argsort(part, kind="stable")
            at, part = alive[sort], part[sort]
            same = np.flatnonzero(part[1:] == part[:-1]) + 1
            fresh = np.full(len(at), -1, np.int64)
            if len(same):
                # the common prefix of new neighbours: least over the old rows between
                pair = np.empty(2 * len(same), np.int64)
                pair[0::2], pair[1::2] = at[same - 1] + 1, at[same] + 1
                padded = np.append(lcp, np.iinfo(np.int64).max)
                fresh[same] = np.minimum.reduceat(padded, pair)[0::2]
            order, lcp = order[at], fresh
            single = (lcp < 0) & np.append(lcp[1:] < 0, True)
            order, lcp = order[~single], lcp[~single]
            interval = np.cumsum(lcp < 0)
    return low, high


def _expand_batches(length: int):
    """Interval expansion over rows that arrive sorted by interval key."""

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        key, lo, hi = (table.column(k).to_numpy() for k in ("key", "lo", "hi"))
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        jlo = np.maximum(table.column("jlo").to_numpy(), lo).astype(np.int64)
        jhi = np.minimum(table.column("jhi").to_numpy(), hi).astype(np.int64)
        full_lo, full_hi = table.column("jlo").to_numpy(), table.column("jhi").to_numpy()
        ctx = [x[a : len(x) - b] for x, a, b in zip(table.column("ctx").to_pylist(), full_hi - jhi, jlo - full_lo, strict=True)]
        low, high = repeated_windows(group, ctx, jlo, jhi, length)
        hit = np.flatnonzero(low <= high)
        if not len(hit):
            return None
        pos = table.column("pos").to_numpy()[hit]
        return pa.RecordBatch.from_arrays([pa.array(table.column("rid").to_numpy()[hit]), pa.array(table.column("t").to_numpy()[hit]), pa.array((pos - high[hit]).astype(np.int32)), pa.array((pos - low[hit] + length).astype(np.int32))], names=["rid", "t", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut and (out := solve(table.slice(0, cut))):
                yield out
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
        if rows and (out := solve(pa.Table.from_batches(held).combine_chunks())):
            yield out

    return run


def _counted(rows: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the counts ``n`` of their keys; rows of keys without a count go.

    Keys with more than ``FREQUENT_ROWS`` rows and one in ``MAX_FREQUENT`` of all, so
    fewer than ``MAX_FREQUENT`` of them, are matched by a broadcast where their rows
    stand; only the others are shuffled, so no task gets all rows of a frequent key.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(FREQUENT_ROWS, (total or 0) // MAX_FREQUENT)
    if (most or 0) <= least:
        return rows.join(counts, by)
    often = F.broadcast(counts.filter(F.col("n") > least))
    rest = rows.join(often, by, "left_anti").join(counts.filter(F.col("n") <= least), by)
    return rows.join(often, by).unionByName(rest)


def _refined(items: DataFrame, length: int) -> DataFrame:
    """Each row's windows cut in half; the key of a half is the string that all
    its windows share, kept as a hash."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
    out = items.withColumn("half", F.explode(halves)).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")})
    out = out.filter("jlo <= hi and jhi >= lo")
    shared = F.substring("ctx", F.col("jhi") - F.col("lo") + 1, F.col("lo") + length - F.col("hi"))
    return out.withColumn("key", F.xxhash64("h", "lo", "hi", shared)).drop("half", "n")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, t, spans): per row key the byte spans covered by a repeated string."""
    rows = keyed(docs, text, doc_id)
    anchors = rows.mapInArrow(_anchor_batches(length, gram), _ANCHORS)
    counts = anchors.select("h", "c").groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1").select("h", "mixed")
    # staged, so that both sides of the join are plain shuffles and a hot key can be split
    counts = B.stage(counts, "suffix-counts")
    hits = B.stage(anchors.join(counts, "h"), "suffix-hits")
    places = hits.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "t", "pos", "jlo", "jhi")).alias("one"), F.max("mixed").alias("mixed"))
    places = B.stage(places, "suffix-places")
    # settled: the same context stands elsewhere
    whole = _counted(hits, places.filter("n > 1").select("h", "c", "n"), ["h", "c"]).select("rid", "t", (F.col("pos") - F.col("jhi")).alias("s"), (F.col("pos") - F.col("jlo") + length).alias("e"))
    # one context of each kind goes on, with all its windows
    wanted = places.filter("mixed").select("h", "one.*").groupBy("rid", "t").agg(F.collect_list(F.struct("pos", "jlo", "jhi", "h")).alias("want"))
    contexts = B.stage(rows.join(wanted, ["rid", "t"]).mapInArrow(_context_batches(length), _CONTEXTS), "suffix-contexts")
    items = contexts.withColumns({"key": F.col("h"), "lo": F.lit(0), "hi": F.lit(length - gram)})
    small, settled = [], [whole]
    while True:
        sizes = B.stage(items.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-sizes")
        sized = _counted(items, sizes, ["key"])
        if sizes.filter(F.col("n") > cap).isEmpty():
            small.append(sized.drop("n"))
            break
        sized = B.stage(sized, "suffix-items")
        small.append(sized.filter(F.col("n") <= cap).drop("n"))
        single = sized.filter((F.col("n") > cap) & (F.col("lo") == F.col("hi")))
        settled.append(single.select("rid", "t", (F.col("pos") - F.col("lo")).alias("s"), (F.col("pos") - F.col("lo") + length).alias("e")))
        items = _refined(sized.filter((F.col("n") > cap) & (F.col("lo") < F.col("hi"))), length)
    tasks = reduce(DataFrame.unionByName, small)
    part = tasks.repartition("key").sortWithinPartitions("key").mapInArrow(_expand_batches(length), "rid long, t long, s int, e int")
    return reduce(DataFrame.unionByName, [*settled, part]).distinct().groupBy("rid", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = B.text_buffer(batch.column("text"))
        removed, runs, digests = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            body = buf[off[i] : off[i + 1]].tobytes()
            gone = B.merged([(x["s"], x["e"]) for x in spans or ()])
            removed.append(sum(e - s for s, e in gone))
            runs.append(len(gone))
            sha, at = hashlib.sha256(), 0
            for s, e in gone:
                sha.update(body[at:s])
                at = e
            sha.update(body[at:])
            digests.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """(doc_id, text, spans) of every row; ``spans`` is null where nothing repeats."""
    rows = keyed(docs).join(repeated_spans(docs, length, gram, cap), ["rid", "t"], "left")
    return rows.select(F.when(F.col("rid") != -(1 << 63), F.col("rid")).alias("doc_id"), "text", "spans")


def dedup_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""
    return with_spans(docs, length, gram, cap).mapInArrow(_strip_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
