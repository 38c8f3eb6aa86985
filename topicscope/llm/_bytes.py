"""Array helpers shared by the operators that scan whole texts.

Inside a task an Arrow string column is one byte buffer with offsets.  The
helpers cut it into runs of whole documents of bounded size and hash words or
byte windows of a run with one prefix sum, so no Python code runs per byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

U64 = np.uint64
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder named by ``spark.checkpoint.dir`` and read it
    back: lineage ends there and a lost executor costs no recomputation."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES * 2)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _TABLES[name] = np.multiply.accumulate(out)
    return have[:n]


def byte_values() -> np.ndarray:
    """One fixed 64-bit value per byte."""
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
    return _TABLES["bytes"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """``P`` with ``P[j] - P[i]`` the weighted sum of ``values[i:j]``."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * _powers("pow", _BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``, the same wherever the span stands."""
    inv = _powers("inv", _BASE_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def doc_chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about
    ``target`` bytes; a longer document is a run of its own."""
    buf, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


# [^\x20\x09-\x0D]+ : every other byte belongs to a word.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per document) of the words of a run."""
    word = ~_SPACE[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    edge[off[(off > 0) & (off < len(buf))]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = word[starts] if len(buf) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_values()[buf]), starts, ends)


def sliding(op, v: np.ndarray, w: int) -> np.ndarray:
    """``out[p] = op(v[p : p + w])`` by doubling; length ``len(v) - w + 1``."""
    if len(v) < w:
        return v[:0]
    m, s = v, 1
    while 2 * s <= w:
        m = op(m[:-s], m[s:])
        s *= 2
    return op(m[: len(m) - (w - s)], m[w - s :]) if s < w else m


def window_anchors(v: np.ndarray, w: int, reach: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of fixed-length windows, chosen by content alone.

    Window ``p`` may choose positions ``p + reach .. p + reach + w - 1``; it takes
    the one of least ``v`` (uint32, over 0; leftmost on ties), so equal windows choose the same
    place.  ``ok[p]`` tells which windows exist.  Returns for every chosen anchor
    its position and the first and last window that chose it.
    """
    empty = np.zeros(0, np.int64)
    least = sliding(np.minimum, v[reach:], w)[: len(ok)]
    n = len(least)
    ok = ok[:n]
    if not n or not ok.any():
        return empty, empty, empty
    cut = np.empty(n + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    edges = np.flatnonzero(cut)
    first, last = edges[:-1], edges[1:] - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    value = least[first].astype(np.uint64)
    # a candidate equals the largest minimum of the windows that reach it;
    # in order of (value, position) each run finds its own by bisection
    wide = np.zeros(n + 2 * (w - 1), v.dtype)
    wide[w - 1 : w - 1 + n] = np.where(ok, least, 0)
    most = sliding(np.maximum, wide, w)
    hit = np.flatnonzero((v[reach : reach + len(most)] == most) & (most > 0)) + reach
    key = np.sort((v[hit].astype(np.uint64) << U64(32)) | hit.astype(np.uint64))
    lo = np.searchsorted(key, (value << U64(32)) | (first + reach).astype(np.uint64))
    hi = np.searchsorted(key, (value << U64(32)) | (last + reach).astype(np.uint64))
    count = hi - lo + 1
    run = np.repeat(np.arange(len(first)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = (key[lo[run] + step] & U64(0xFFFFFFFF)).astype(np.int64)
    before = np.where(step > 0, (key[lo[run] + step - 1] & U64(0xFFFFFFFF)).astype(np.int64) - reach + 1, first[run])
    return at, np.maximum(before, first[run]), np.minimum(at - reach, last[run])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal runs in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
