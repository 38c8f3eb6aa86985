"""Alignment of two tokenizers over the distinct texts of a corpus.

Equal texts are brought together by a shuffle on the full text (counted before it,
so a text that a third of all rows hold crosses the network once per task).  Each
distinct text is encoded once by a byte-level tokenizer (A) and a piece model (B).
Both give the same bytes, so the offsets where a token of A and one of B both end
cut them into groups, and the two tokens that end there are linked.  Links are
counted by id pair over the corpus, each text weighted by how often it occurs.

A text's measures need the corpus count of every pair it links.  A pair that holds
at least one of ``SHARE`` links is frequent; there are at most ``SHARE`` of them, and
their counts travel to every task.  The other links are joined by a shuffle, in which
no pair holds more than that share.  Measures come back to the documents by the
SHA-256 of their text in the same two ways: texts held by at least one of
``TEXT_SHARE`` rows are broadcast, at most ``TEXT_SHARE`` of them.

Null and empty texts, and texts whose bytes one of the tokenizers changes, have no
tokens: all counts are zero and the digest is the empty string.  Rows with equal
texts each get the row of that text; ids may be null or repeat.  The strings of
special tokens are plain text.  A text is held whole in its task, with some 60 bytes
of arrays a byte.  Equal counts are all highest.  Other columns are not read, and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._bytes import stage

SHARE = 100_000
TEXT_SHARE = 1_000
_CHUNK_CHARS = 1 << 20
_HELD = 1 << 22

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


# ---------------------------------------------------------------- one run of texts

def _labels(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every id below ``size``, right-aligned with a free place at
    the end for a separator, and how many places each takes."""
    width = len(str(max(size - 1, 0)))
    ids = np.arange(size)
    digits = np.zeros((size, width + 1), np.uint8)
    for d in range(width):
        digits[:, width - 1 - d] = ord("0") + ids // 10**d % 10
    used = np.ones(size, np.int64)
    for d in range(1, width):
        used += ids >= 10**d
    return digits, used + 1


class Aligner:
    """Encodes texts by both tokenizers and cuts them at common token ends."""

    def __init__(self, byte_path: str, piece_path: str):
        self.encode = _tokens.byte_level_encoder(byte_path, False)
        self.pieces = _tokens.piece_model(piece_path)
        self.bytes_a, self.bytes_b = _tokens.byte_level_bytes(byte_path), _tokens.piece_bytes(piece_path)
        self.len_a, self.len_b = (np.array([len(b) for b in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.digits, self.places = _labels(max(len(self.len_a), len(self.len_b)))

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            a, raw = self.encode(spaced), spaced.encode()
            same = b"".join([self.bytes_a[i] for i in a.tolist()]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else None)
        return out

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) per text."""
        tokens = self.tokens(texts)
        held = [t for t in tokens if t is not None]
        if not held:
            return [(0, 0, 0, 0, "", [], [])] * len(texts)
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        off_a, off_b = (np.cumsum([0, *map(len, x)]) for x in zip(*held, strict=True))
        # texts follow each other, so ends rise over the whole run and meet at each text's end
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(end_b, end_a)
        ia = np.flatnonzero(end_b[at] == end_a)
        ib = at[ia]
        groups = np.searchsorted(ia, off_a)
        text_of = np.repeat(np.arange(len(held)), np.diff(groups))
        span = np.int64(len(self.len_a)) * len(self.len_b)
        code, times = np.unique(text_of * span + a[ia] * len(self.len_b) + b[ib], return_counts=True)
        cut = np.searchsorted(code, np.arange(len(held) + 1) * span)
        code %= span
        digests = self._digests(a, b, ia, ib, off_a, off_b)
        done = iter(range(len(held)))
        rows = []
        for t in tokens:
            if t is None:
                rows.append((0, 0, 0, 0, "", [], []))
                continue
            i = next(done)
            n = int(groups[i + 1] - groups[i])
            rows.append((len(t[0]), len(t[1]), n, n, digests[i], code[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]))
        return rows

    def _digests(self, a, b, ia, ib, off_a, off_b) -> list[str]:
        i, j = np.arange(len(a)), np.arange(len(b))
        group_a, group_b = np.searchsorted(ia, i), np.searchsorted(ib, j)
        before = np.concatenate([[0], ib + 1])
        place_a, place_b = i + before[group_a], j + ia[group_b] + 1
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        sep = np.full(len(ids), ord(","), np.uint8)
        sep[place_a[ia]], sep[place_b[ib]] = ord("|"), ord(";")
        label = self.digits[ids]
        label[:, -1] = sep
        places = self.places[ids]
        flat = label[np.arange(label.shape[1]) >= (label.shape[1] - places)[:, None]]
        ends = np.concatenate([[0], np.cumsum(places)])[off_a + off_b]
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)]


# ---------------------------------------------------------------- Spark

def _align_batches(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = np.cumsum([0, *map(len, texts)])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + _CHUNK_CHARS, side="right")) - 1)
                n_a, n_b, groups, links, digest, pairs, times = zip(*aligner.align(texts[lo:hi]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        *(pa.array(c, pa.int64()) for c in (n_a, n_b, groups, links)),
                        pa.array(digest, pa.string()),
                        pa.array(pairs, pa.list_(pa.int64())),
                        pa.array(times, pa.list_(pa.int32())),
                    ],
                    ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                lo = hi

    return run


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, how often each is linked, and where each row's begin and end."""
    pairs, times = batch.column("pairs"), batch.column("times")
    off = pairs.offsets.to_numpy()
    t_off = times.offsets.to_numpy()
    return pairs.values.to_numpy()[off[0] : off[-1]], times.values.to_numpy()[t_off[0] : t_off[-1]].astype(np.int64), off - off[0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by pair, added up within the task as far as memory allows."""

    def add(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pair[first], np.add.reduceat(n, first)

    held, size = [], 0
    for batch in batches:
        pair, times, off = _lists(batch)
        if not len(pair):
            continue
        held.append((pair, times * np.repeat(batch.column("copies").to_numpy(), np.diff(off))))
        size += len(pair)
        if size > _HELD:
            held = [add(held)]
            size = len(held[0][0])
            if size > _HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["pair", "n"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in add(held)], ["pair", "n"])


def _measure_batches(pair: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Sums over a text's frequent pairs; its other pairs are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, times, off = _lists(batch)
            at = np.minimum(np.searchsorted(pair, code), max(len(pair) - 1, 0))
            known = pair[at] == code if len(pair) else np.zeros(len(code), bool)
            at = at[known]

            def per_text(x: np.ndarray, where: np.ndarray) -> np.ndarray:
                full = np.zeros(len(code) + 1, np.int64)
                full[1:][where] = x
                return np.diff(np.cumsum(full)[off])

            rare = np.concatenate([[0], np.cumsum(~known)])[off].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(per_text(times[known] * best[at], known)),
                    pa.array(per_text(times[known] * n[at], known)),
                    pa.ListArray.from_arrays(pa.array(rare), pa.array(code[~known])),
                    pa.ListArray.from_arrays(pa.array(rare), pa.array(times[~known])),
                ],
                ["key", "n_best", "count_sum", "pairs", "times"],
            )

    return run


def aligned_texts(docs: DataFrame, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """One row per distinct non-empty text: key (SHA-256), copies, token counts, the
    digest of its groups, and its linked pairs (``a * size of B + b``) with counts."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    return keyed.mapInArrow(_align_batches(byte_path, piece_path), _ALIGNED)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): corpus links of every id pair and whether no other pair of
    its B id has more.  B ids are at most ``size_b``, so their maxima are broadcast."""
    links = aligned.select("copies", "pairs", "times").mapInArrow(_count_batches, "pair long, n long")
    counts = stage(links.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % size_b), "alignment-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def token_alignment(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_path: str | None = None,
    piece_path: str | None = None,
    share: int = SHARE,
    text_share: int = TEXT_SHARE,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    byte_path = byte_path or _tokens.default_path("byte_bpe_50k.json")
    piece_path = piece_path or _tokens.default_path("piece_bpe_32k.model")
    aligned = stage(aligned_texts(docs, text_col, byte_path, piece_path), "alignment-texts")
    counts = stage(pair_counts(aligned, len(_tokens.piece_bytes(piece_path))), "alignment-pairs")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = counts.filter(F.col("n") * share >= total).orderBy("pair").toPandas()  # at most `share` rows
    columns = (frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(np.int64))
    known = stage(
        aligned.select("key", "pairs", "times").mapInArrow(_measure_batches(*columns), "key binary, n_best long, count_sum long, pairs array<long>, times array<long>"),
        "alignment-known",
    )
    rare = known.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    rare = rare.join(counts, "pair").select("key", F.when(F.col("best"), F.col("t")).otherwise(0).alias("n_best"), (F.col("t") * F.col("n")).alias("count_sum"))
    sums = known.select("key", "n_best", "count_sum").unionByName(rare).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = stage(aligned.drop("pairs", "times").join(sums, "key"), "alignment-measures")

    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(text_col) != "", F.unhex(F.sha2(F.col(text_col).cast("string"), 256))).alias("key")), "alignment-rows")
    n = rows.count()
    held = measures.select("key", "copies", *MEASURES, "groups_sha256")
    often = F.broadcast(held.filter(F.col("copies") * text_share >= n).drop("copies"))  # at most `text_share` rows
    seldom = held.filter(F.col("copies") * text_share < n).drop("copies")
    blank = rows.filter("key is null").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in MEASURES), F.lit("").alias("groups_sha256"))
    return (
        rows.join(often, "key").drop("key")
        .unionByName(rows.filter("key is not null").join(often.select("key"), "key", "left_anti").join(seldom, "key").drop("key"))
        .unionByName(blank)
    )
