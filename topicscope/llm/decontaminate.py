"""Benchmark items inside documents, paraphrased ones too, by latent retrieval.

1. Tokens (lower-cased runs of letters and digits) are hashed into terms and counted
   in all passages of ``PASSAGE`` tokens of all documents; how many passages hold a
   term gives its idf.
2. A randomised SVD of TF-IDF rows - all items and all passages of all documents -
   gives every term a place in ``rank`` latent dimensions, each scaled by its
   singular value.  All items together weigh a tenth of all passages, or more
   where there are few, so that the space does not depend on the input's size.
   The passages are cut into term counts once, which stay in Spark.  Every pass over
   them sends one partial matrix per task, in row blocks that are summed by block;
   ``power`` passes sharpen the range, and the last one gives the singular values too
   (Nystrom).
3. Every document is searched whole: windows of an item's length, every
   ``STEP`` tokens (every token for items under one and a half steps), are sums
   of latent vectors, and those whose cosine with the item is at least ``cosine``
   are candidates.  The README gives the share of matches that are candidates.
4. The tokens of a candidate that the item has too bound the subsequence from
   above; they are counted by slots of a hash, which can only raise the bound.
5. A candidate counts if the longest common subsequence of item and window
   holds ``same`` of the item's tokens, or ``part`` of them and, as a paraphrase
   must, also the item's answer (its closing tokens).

The items are a benchmark: blocks of at most ``MAX_ITEMS`` and ``MAX_TOKENS``
tokens (a longer item is a block) are sent to every task; the documents are
searched once per block.  Null and empty texts
and items match nothing; repeated rows are matched each on its own (matches are
by id); equal items are all reported; extra columns are ignored (``clean`` keeps
those of the documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

BITS = 15
PASSAGE = 64
RANK, OVER, POWER = 48, 8, 0
ITEMS_SHARE = 0.1
GROUP = 24
STEP = 8
COSINE = 0.45
SAME, PART, ANSWER = 0.75, 0.5, 6
MAX_ITEMS, MAX_TOKENS = 20_000, 2_000_000
TERM_BLOCK = 4096
SLOTS = 1024
CELLS = 1 << 22

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_z] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a run of documents and their offsets per document."""
    word = _WORD[buf]
    edge = np.ones(len(buf) + 1, bool)
    np.not_equal(word[1:], word[:-1], out=edge[1:-1]) if len(buf) else None
    edge[off[(off > 0) & (off < len(buf))]] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = word[start] if len(buf) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return B.word_hashes(B.ascii_lower(buf), start, end), np.searchsorted(start, off)


def term(h: np.ndarray) -> np.ndarray:
    return (h >> B.U64(64 - BITS)).astype(np.int64)


def slot(h: np.ndarray) -> np.ndarray:
    return (h & B.U64(SLOTS - 1)).astype(np.int64)


def passage(at: np.ndarray) -> np.ndarray:
    """The passage of every token, numbered through a run of documents."""
    size = np.diff(at)
    blocks = -(-size // PASSAGE)
    first = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(size)), size)
    return first[doc] + (np.arange(len(doc)) - at[doc]) // PASSAGE


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary cell per run of values."""
    offsets = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of every passage with their counts."""
    for batch in batches:
        for _, _, buf, off in B.doc_chunks(batch.column("text")):
            h, at = tokens(buf, off)
            if not len(h):
                continue
            cell, count = np.unique(passage(at) << BITS | term(h), return_counts=True)
            block = cell >> BITS
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            yield pa.RecordBatch.from_arrays([_binaries((cell & ((1 << BITS) - 1)).astype(np.uint16), starts), _binaries(count.astype(np.uint8), starts)], names=["terms", "counts"])


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's passages, and in how many of them each term occurs."""
    df, passages = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        df += np.bincount(B.text_buffer(batch.column("terms"))[0].view(np.uint16), minlength=1 << BITS)
        passages += batch.num_rows
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], passages))], names=["term", "n"])


def inverse_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """idf of every hashed term over all passages, and their number."""
    found = rows.select("terms").mapInArrow(_frequency_batches, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << BITS) + 1)
    for r in found:
        df[r.term] = r.n
    return np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0, int(df[-1])


def _groups_of(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF rows (of the length in ``weight``) in small groups: their terms, and a
    dense matrix over these."""
    (t, off), (n, _) = (B.text_buffer(batch.column(c)) for c in ("terms", "counts"))
    t, off = t.view(np.uint16).astype(np.int64), off // 2
    if not len(t):
        return
    w = n * idf[t]
    w = (w * np.repeat(batch.column("weight").to_numpy() / np.sqrt(np.add.reduceat(w * w, off[:-1])), np.diff(off))).astype(np.float32)
    place, seen = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    for lo in range(0, len(off) - 1, GROUP):
        at = off[lo : lo + GROUP + 1]
        own = t[at[0] : at[-1]]
        seen[own] = True
        terms = np.flatnonzero(seen)
        seen[terms] = False
        place[terms] = np.arange(len(terms))
        m = np.zeros((len(at) - 1, len(terms)), np.float32)
        m[np.repeat(np.arange(len(at) - 1), np.diff(at)), place[own]] = w[at[0] : at[-1]]
        yield terms, m


def _power_batches(q: np.ndarray, idf: np.ndarray):
    """A task's share of A'(A q), in blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.shape)
        for batch in batches:
            for terms, m in _groups_of(batch, idf):
                total[terms] += m.T @ (m @ q[terms])
        blocks = [total[i : i + TERM_BLOCK] for i in range(0, len(total), TERM_BLOCK)]
        used = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].astype(np.float32).tobytes() for i in used], pa.binary())], names=["block", "m"])

    return run


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Blocks added up per block in Spark; the matrix itself has a fixed size."""
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, np.float32) for m in pdf["m"])
        return pd.DataFrame({"block": pdf["block"][:1], "m": [total.tobytes()]})

    out = np.zeros(shape)
    for r in parts.groupBy("block").applyInPandas(add, "block int, m binary").toLocalIterator():
        rows = np.frombuffer(bytes(r.m), np.float32).reshape(-1, shape[1])
        out[r.block * TERM_BLOCK : r.block * TERM_BLOCK + len(rows)] = rows
    return out


def latent_terms(rows: DataFrame, idf: np.ndarray, rank: int = RANK, over: int = OVER, power: int = POWER) -> np.ndarray:
    """Latent vector of each hashed term, scaled by idf and singular values."""
    n = 1 << BITS
    q = np.random.default_rng(11).standard_normal((n, rank + over)).astype(np.float32)
    for step in range(power + 1):
        q = q if not step else np.linalg.qr(z)[0].astype(np.float32)  # shipped to every task
        z = _summed(rows.mapInArrow(_power_batches(q, idf), "block int, m binary"), q.shape)
    # Nystrom: A'A is near z (q'z)^-1 z', whose root's left singular vectors are A's right ones
    core = q.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    use = values > 1e-6 * max(1e-12, values.max(initial=0))
    u, sigma, _ = np.linalg.svd(z @ (vectors[:, use] / np.sqrt(values[use])), full_matrices=False)
    u, sigma = u[:, :rank], sigma[:rank]
    scale = np.where(sigma > 1e-6 * max(1e-12, sigma.max(initial=0)), 1 / np.maximum(sigma, 1e-12), 0)
    return (idf[:, None] * u * scale).astype(np.float32)


@dataclass
class Items:
    """The benchmark as every task sees it."""

    ids: list[int]
    tokens: list[np.ndarray]
    blocks: np.ndarray  # window length in steps, negative: in tokens
    vectors: np.ndarray

    def masks(self, i: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, t in enumerate(self.tokens[i].tolist()):
            out[t] = out.get(t, 0) | 1 << k
        return out


def common_subsequence(masks: dict[int, int], n: int, other: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence, bit-parallel over the item; 0
    where fewer than ``least`` tokens occur in the item at all."""
    shared = list(filter(None, map(masks.get, other)))
    if len(shared) < least:
        return 0
    full = (1 << n) - 1
    v = full
    for m in shared:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _items(rows: list, latent: np.ndarray) -> Items:
    ids, words = [i for i, _ in rows], [w for _, w in rows]
    vectors = np.array([latent[term(w)].sum(axis=0) for w in words], np.float32).reshape(len(words), latent.shape[1])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    blocks = np.array([round(len(w) / STEP) if 2 * len(w) >= 3 * STEP else -len(w) for w in words], np.int64)
    return Items(ids, words, blocks, vectors)


def item_blocks(benchmark: DataFrame, latent: np.ndarray) -> list[Items]:
    """All items with tokens, in blocks under the two bounds; one block at least."""
    out, rows, total = [], [], 0
    for r in benchmark.filter("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        w = tokens(*B.text_buffer(pa.array([r.text], pa.string())))[0]
        if not len(w):
            continue
        if rows and (len(rows) == MAX_ITEMS or total + len(w) > MAX_TOKENS):
            out.append(_items(rows, latent))
            rows, total = [], 0
        rows.append((r.item_id, w))
        total += len(w)
    return [*out, _items(rows, latent)]


def _search_batches(items: Items, latent: np.ndarray, cosine: float, same: float, part: float, answer: int):
    masks = [items.masks(i) for i in range(len(items.ids))]
    closing = []
    for w in items.tokens:
        tail = w[-min(answer, len(w)) :].tolist()
        m: dict[int, int] = {}
        for k, t in enumerate(tail):
            m[t] = m.get(t, 0) | 1 << k
        closing.append((m, len(tail)))
    sizes = sorted(set(items.blocks.tolist()))
    groups = {k: np.flatnonzero(items.blocks == k) for k in sizes}
    padded = np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)])
    has = np.zeros((len(items.ids), SLOTS + 1), np.uint8)  # the last slot is no token's
    for i, w in enumerate(items.tokens):
        has[i, slot(w)] = 1
    has = has.ravel()
    least = np.array([int(part * len(w)) for w in items.tokens], np.int64)

    def windows(total: np.ndarray, first: np.ndarray, k: int):
        """(document, start, end, vector, length) of windows of ``k`` rows of a
        run of documents, from running sums.  Those at a document's end are
        shorter and left out, but for its first."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        start = np.arange(len(owner))
        end = np.minimum(start + k, first[owner + 1])
        use = (end - start == k) | (start == first[owner])
        s, e = start[use], end[use]
        v = (total[e] - total[s]).astype(np.float32)
        return owner[use], s, e, v, np.sqrt(np.einsum("ij,ij->i", v, v))

    def possible(slots: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether enough tokens of ``lo .. hi`` fall on a slot of the item."""
        out = np.zeros(len(item), bool)
        for a in range(0, len(item), 4096):
            one = slice(a, a + 4096)
            at = lo[one, None] + np.arange(int((hi[one] - lo[one]).max()))
            on = np.where(at < hi[one, None], slots[np.minimum(at, len(slots) - 1)], SLOTS)
            out[one] = has[on + item[one, None] * (SLOTS + 1)].sum(axis=1, dtype=np.int64) >= least[item[one]]
        return out

    def candidates(h: np.ndarray, at: np.ndarray):
        """(document, item, first token, end token) of the windows near an item,
        with a margin of one step on either side."""
        if not len(h):
            return
        size = np.diff(at)
        t = term(h)
        slots = slot(h)
        steps = -(-size // STEP)
        first = np.append(0, np.cumsum(steps))
        place = np.full(first[-1] * STEP, 1 << BITS, np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        place[first[doc] * STEP + np.arange(len(h)) - at[doc]] = t
        sums = padded[place[::STEP]]
        for j in range(1, STEP):
            sums += padded[place[j::STEP]]
        running = lambda x: np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
        run = running(sums)
        fine = running(latent[t]) if sizes[0] < 0 else None
        for k, members in groups.items():
            d_, s_, e_, v, norm = windows(run, first, k) if k > 0 else windows(fine, at, -k)
            vectors, limit = items.vectors[members].T, cosine * np.maximum(norm, 1e-12)[:, None]
            rows = max(1, CELLS // len(members))
            for a in range(0, len(v), rows):
                w, m = np.nonzero(v[a : a + rows] @ vectors >= limit[a : a + rows])
                if not len(w):
                    continue
                d, s, e, m = d_[a + w], s_[a + w], e_[a + w], members[m]
                if k > 0:
                    s, e = at[d] + (s - first[d]) * STEP, at[d] + (e - first[d]) * STEP
                lo, hi = np.maximum(at[d], s - STEP), np.minimum(at[d + 1], e + STEP)
                ok = possible(slots, m, lo, hi)
                yield from zip(d[ok].tolist(), m[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if items.ids else ():
            key = batch.column("key").to_pylist()
            for lo, _, buf, off in B.doc_chunks(batch.column("text")):
                h, at = tokens(buf, off)
                listed = h.tolist()
                best: dict[tuple[int, int], float] = {}
                for d, i, lo_, hi_ in candidates(h, at):
                    n = len(items.tokens[i])
                    near = listed[lo_:hi_]
                    share = common_subsequence(masks[i], n, near, int(part * n)) / n
                    if share < part or share <= best.get((d, i), 0.0):
                        continue
                    if share < same:
                        m, size = closing[i]
                        if common_subsequence(m, size, near) < 0.8 * size:
                            continue
                    best[d, i] = share
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays([pa.array([key[lo + d] for (d, _), _ in rows], pa.int64()), pa.array([items.ids[i] for (_, i), _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.float64())], names=["key", "item_id", "share"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", rank: int = RANK, cosine: float = COSINE, same: float = SAME, part: float = PART, answer: int = ANSWER) -> DataFrame:
    """(key, item_id, share): items found in documents, with the share of the
    item's tokens in the common subsequence."""
    body = docs.select(F.col(key).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    asked = benchmark.filter("item_id is not null and text is not null").select("text")
    # texts are cut into passages once; idf and length are put on as the rows are read
    row = "terms binary, counts binary"
    cut = B.stage(body.select("text").mapInArrow(_row_batches, row), "latent-rows")
    idf, passages = inverse_frequency(cut)
    weight = max(1.0, (ITEMS_SHARE * passages / max(1, asked.count())) ** 0.5)
    rows = cut.withColumn("weight", F.lit(1.0)).unionByName(asked.mapInArrow(_row_batches, row).withColumn("weight", F.lit(weight)))
    # a task's partial matrix has a fixed size, so their number follows the cores
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    latent = latent_terms(rows, idf, rank)
    found = [body.mapInArrow(_search_batches(items, latent, cosine, same, part, answer), "key long, item_id long, share double") for items in item_blocks(benchmark, latent)]
    return reduce(DataFrame.unionByName, found)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share of every item found in a document."""
    return matches(docs, benchmark).select(F.col("key").alias("doc_id"), "item_id", F.round("share", 6).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, as they were (rows without an id stay)."""
    found = B.stage(matches(docs, benchmark).filter("key is not null").select(F.col("key").alias("doc_id")).distinct(), "leaks")
    return docs.join(found, docs.doc_id == found.doc_id, "left_anti")
