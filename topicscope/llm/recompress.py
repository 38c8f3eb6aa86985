"""Removal of long word sequences that occur more than once in the corpus.

A word goes when a window of ``window`` consecutive words of one document that
covers it also starts anywhere else.  The method is recompression.  Every word
gets a name; each round names maximal runs of one symbol, then pairs of a left
and a right symbol, sides being drawn from the names.  A name is a 64-bit hash
of what it stands for, so it is the same in every task and no dictionary is
exchanged.  Equal word sequences therefore get equal symbols in their interior.
Every symbol carries the words that decided it; a symbol decided inside a
window exists wherever the window does.

1. Each window takes the highest symbol decided inside it (least hash on ties)
   as its anchor; the anchor's name with its deciding words is the key.
2. Spark counts the keys: windows whose key is found once are unique.
3. Where all windows of an anchor are the same elsewhere, counting their common
   name settles them; one place of every other kind goes on.
4. Those name their windows in full and Spark counts the names.

No key's rows are gathered in one task: counts are partial sums and joins are
on counted keys.  Null and empty texts have no words; repeated rows repeat each
other's windows and lose them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .suffix_dedup import keyed

WINDOW = 35
BEFORE, AFTER = 4, 8
ROUNDS = 3

_ANCHORS = "rid long, t long, pos int, p0 int, p1 int, h long, c long"
_FAR = 1 << 40


def recompressed(names: np.ndarray, doc: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """After every round: first word of each symbol, its name, and the span of
    words that decided it (far away where a document's end took part)."""
    at = np.arange(len(names))
    lo, hi = at.copy(), at + 1
    for r in range(rounds):
        if len(names) < 2:
            return
        # runs: a maximal run of one symbol becomes one block, decided also by
        # the symbols beside it
        same_doc = doc[1:] == doc[:-1]
        head = np.append(True, ~((names[1:] == names[:-1]) & same_doc))
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(names)) - 1
        size = last - first + 1
        prev_ok = (first > 0) & (doc[first] == doc[np.maximum(first - 1, 0)])
        next_at = np.minimum(last + 1, len(names) - 1)
        next_ok = (last + 1 < len(names)) & (doc[last] == doc[next_at])
        lo2 = np.where(prev_ok, lo[np.maximum(first - 1, 0)], -_FAR)
        hi2 = np.where(next_ok, hi[next_at], _FAR)
        # the neighbours' own spans may reach over to the far side
        lo2 = np.minimum(lo2, np.minimum(np.minimum.reduceat(lo, first), np.where(next_ok, lo[next_at], _FAR)))
        hi2 = np.maximum(hi2, np.maximum(np.maximum.reduceat(hi, first), np.where(prev_ok, hi[np.maximum(first - 1, 0)], -_FAR)))
        block = names[first]
        names = np.where(size > 1, B.mix(block + B.U64(0xA24BAED4963EE407) * size.astype(np.uint64)), block)
        at, lo, hi, doc = at[first], lo2, hi2, doc[first]
        if len(names) < 2:
            return
        # pairs: a left symbol followed by a right one
        left = (B.mix(names + B.U64(2 * r + 1)) & B.U64(1)).astype(bool)
        pair = np.append(left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]), False)
        second = np.append(False, pair[:-1])
        # what stays single was decided by the neighbour it did not pair with
        partner = np.where(left, np.arange(len(names)) + 1, np.arange(len(names)) - 1)
        inside = (partner >= 0) & (partner < len(names))
        partner = np.clip(partner, 0, len(names) - 1)
        inside &= doc[partner] == doc
        lo2 = np.minimum(lo, np.where(inside, lo[partner], np.where(left, lo, -_FAR)))
        hi2 = np.maximum(hi, np.where(inside, hi[partner], np.where(left, _FAR, hi)))
        joined = np.where(pair, B.mix(names * B.U64(0x9FB21C651E98DF25) ^ np.append(names[1:], B.U64(0))), names)
        keep = ~second
        names, at, lo, hi, doc = joined[keep], at[keep], lo2[keep], hi2[keep], doc[keep]
        yield at, names, lo, hi


def anchor_order(names: np.ndarray, doc: np.ndarray, before: int, after: int, rounds: int) -> np.ndarray:
    """Per word the rank (least first) of the highest symbol that starts there
    and was decided by the words ``-before .. after`` around it."""
    value = (B.mix(names) >> B.U64(36)).astype(np.uint32) | np.uint32((rounds + 1) << 28)
    for level, (at, sym, lo, hi) in enumerate(recompressed(names, doc, rounds)):
        sure = (lo >= at - before) & (hi <= at + after)
        value[at[sure]] = (B.mix(sym[sure]) >> B.U64(36)).astype(np.uint32) | np.uint32((rounds - level) << 28)
    return value


def _words(buf: np.ndarray, off: np.ndarray):
    starts, ends, woff = B.word_spans(buf, off)
    names = B.word_hashes(buf, starts, ends)
    return starts, ends, woff, names, np.repeat(np.arange(len(off) - 1), np.diff(woff))


def _anchor_batches(window: int, before: int, after: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, t = batch.column("rid").to_numpy(), batch.column("t").to_numpy()
            for lo, _, buf, off in B.doc_chunks(batch.column("text")):
                _, _, woff, names, doc = _words(buf, off)
                n = len(names)
                if n < window:
                    continue
                ok = doc[: n - window + 1] == doc[window - 1 :]
                value = anchor_order(names, doc, before, after, rounds)
                pos, first, last = B.window_anchors(value, window - before - after + 1, before, ok)
                if not len(pos):
                    continue
                prefix = B.prefix_sums(names)
                key = B.span_hash(prefix, pos - before, pos + after)
                same = B.mix(B.span_hash(prefix, first, last + window) + (pos - first).astype(np.uint64))
                row = doc[pos]
                base = woff[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[lo + row]), pa.array(t[lo + row]), *(pa.array((x - base).astype(np.int32)) for x in (pos, first, last)), pa.array(key.view(np.int64)), pa.array(same.view(np.int64))],
                    names=["rid", "t", "pos", "p0", "p1", "h", "c"],
                )

    return run


def _window_batches(window: int):
    """Full names of the wanted windows: two independent 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            woff_list = want.offsets.to_numpy() - want.offsets.to_numpy()[0]
            flat = want.flatten()
            p0, p1 = flat.field("p0").to_numpy(), flat.field("p1").to_numpy()
            rid, t = batch.column("rid").to_numpy(), batch.column("t").to_numpy()
            for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
                _, _, woff, names, _ = _words(buf, off)
                a, b = woff_list[lo], woff_list[hi]
                row = np.repeat(np.arange(hi - lo), np.diff(woff_list[lo : hi + 1]))
                count = (p1[a:b] - p0[a:b] + 1).astype(np.int64)
                which = np.repeat(np.arange(b - a), count)
                start = p0[a:b][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                at = start + woff[row[which]]
                one = B.span_hash(B.prefix_sums(names), at, at + window)
                two = B.span_hash(B.prefix_sums(B.mix(names + B.U64(99))), at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(rid[lo + row[which]]), pa.array(t[lo + row[which]]), pa.array(start.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["rid", "t", "s", "w1", "w2"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, before: int = BEFORE, after: int = AFTER, rounds: int = ROUNDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, t, spans): per row key the word spans covered by a repeated window."""
    rows = keyed(docs, text, doc_id)
    anchors = rows.mapInArrow(_anchor_batches(window, before, after, rounds), _ANCHORS)
    counts = anchors.select("h", "c").groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1").select("h", "mixed")
    # staged, so that both sides of the join are plain shuffles and a hot key can be split
    counts = B.stage(counts, "recompress-counts")
    hits = B.stage(anchors.join(counts, "h"), "recompress-hits")
    places = hits.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "t", "p0", "p1")).alias("one"), F.max("mixed").alias("mixed"))
    whole = hits.join(places.filter("copies > 1").select("h", "c"), ["h", "c"], "left_semi").select("rid", "t", F.col("p0").alias("s"), (F.col("p1") + window).alias("e"))
    wanted = places.filter("mixed").select("one.*").groupBy("rid", "t").agg(F.collect_list(F.struct("p0", "p1")).alias("want"))
    named = B.stage(rows.join(wanted, ["rid", "t"]).mapInArrow(_window_batches(window), "rid long, t long, s int, w1 long, w2 long"), "recompress-windows")
    twice = named.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    part = named.join(twice, ["w1", "w2"], "left_semi").select("rid", "t", "s", (F.col("s") + window).alias("e"))
    return whole.unionByName(part).distinct().groupBy("rid", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, removed, digests = [], [], []
        spans = batch.column("spans").to_pylist()
        for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
            starts, ends, woff = B.word_spans(buf, off)
            body = buf.tobytes()
            for i in range(lo, hi):
                a, b = woff[i - lo], woff[i - lo + 1]
                gone = np.zeros(b - a + 1, np.int32)
                for x in spans[i] or ():
                    gone[x["s"]] += 1
                    gone[x["e"]] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                words.append(b - a)
                removed.append(b - a - len(keep))
                kept = b" ".join([body[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                digests.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_report(docs: DataFrame, window: int = WINDOW, before: int = BEFORE, after: int = AFTER, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that are left."""
    rows = keyed(docs).join(repeated_spans(docs, window, before, after, rounds), ["rid", "t"], "left")
    rows = rows.select(F.when(F.col("rid") != -(1 << 63), F.col("rid")).alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_strip_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")
