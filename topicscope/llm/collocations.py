"""Phrase collocations by weighted acyclic automata.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and
these into words.  Each task cuts its texts into shards of whole documents of bounded
size.  The n-grams of a shard (1 to 3 words, inside pieces, by language) are sorted,
and a count transducer is built from them: an acyclic automaton over words in which
an arc carries the count of the n-gram that it completes, and states with equal
arcs are one state, registered from the longest prefixes to the root.

A shard's transducers are cut by prefix range, a range of the hash of an n-gram's
first two words (longer continuations of one pair are spread over ``SPREAD``
neighbouring ranges).  Spark brings the shards' transducers of a range together; their
union sums the weights, and n-grams below the least count are pruned.  What is left of
all ranges holds every candidate and every part of one, since a part occurs at least as
often as its phrase.  The parts of all candidates are then composed with the pruned
transducers: each part is sent to its range and walked through that automaton.  A range
is copied to ``SALTS`` tasks, so that a part that very many phrases share is looked up in
several.  The number of ranges follows the bytes of the table.

Null texts count as empty, a null language as ``und``.  Empty texts add nothing.  Equal
rows count each time; ids are not needed and other columns not read.  A text is held
whole in its task, with some 100 bytes of arrays a byte.  Ties of the lowest cut go to
the shorter first part, ties of rank to the larger count and then the phrase in byte
order.  An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import top_k_per_group
from . import _bytes as B
from ._bytes import U64, stage

MIN_COUNT = 10
TOP = 2000
SCALE = 1_000_000
COVERED = 50
SPREAD = 16
SALTS = 8
SHARD_BYTES = 1 << 23
RANGE_BYTES = 6 << 20
_HELD = 1 << 21
_WIDE = np.int64(1) << 62

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _PIECE_END.copy()
_GAP[[0x20, 0x09]] = True


# ---------------------------------------------------------------- automata

def fold(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One integer per row that orders rows as their columns do; dense numbers are
    taken wherever the product of the sizes would pass 62 bits."""
    key, room = columns[0].astype(np.int64), int(sizes[0])
    for c, size in zip(columns[1:], sizes[1:], strict=True):
        if room * int(size) >= _WIDE:
            values, key = np.unique(key, return_inverse=True)
            room = len(values)
        key = key * np.int64(size) + c
        room *= int(size)
    return key


def _runs(flags: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(flags), len(flags))


def _register(begin: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """States are runs of arcs ``begin[i]:begin[i + 1]``; equal runs are one state.
    Returns the state of every run, and the run that stands for each state."""
    degree = np.diff(begin)
    state, stands = np.empty(len(degree), np.int64), []
    made = 0
    order = np.argsort(degree, kind="stable")
    cuts = _runs(np.diff(degree[order], prepend=-1) != 0)
    sizes = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        runs = order[lo:hi]
        m = int(degree[runs[0]])
        if len(runs) == 1:
            first, inverse = np.zeros(1, np.int64), np.zeros(1, np.int64)
        elif m <= 4:
            key = fold([c[begin[runs] + i] for i in range(m) for c in columns], sizes * m)
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        else:
            table = np.concatenate([c[begin[runs][:, None] + np.arange(m)] for c in columns], axis=1)
            _, first, inverse = np.unique(np.ascontiguousarray(table).view(np.dtype((np.void, table.itemsize * table.shape[1]))).ravel(), return_index=True, return_inverse=True)
        state[runs] = made + inverse
        stands.append(runs[first])
        made += len(first)
    return state, np.concatenate(stands) if stands else np.zeros(0, np.int64)


def _least(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


class Transducer:
    """An acyclic automaton over a language and up to three words, with counts.

    ``levels[d]`` holds the arcs of depth ``d`` by (state, symbol): the degree of every
    state, and per arc its symbol, the count of the n-gram it completes (0: none) and
    its target's number plus one on the next level (0: none).  Languages are the symbols
    of level 0, words those of the others, both numbered in byte order from 1."""

    def __init__(self, langs: pa.Array, words: pa.Array, levels: list[tuple[np.ndarray, ...]]):
        self.langs, self.words, self.levels = langs, words, levels

    @classmethod
    def build(cls, langs: pa.Array, words: pa.Array, grams: list[np.ndarray], counts: np.ndarray) -> Transducer:
        """``grams``: language and three word columns (0 beyond an n-gram's end) of
        distinct n-grams; symbols number the sorted ``langs`` and ``words`` from 1."""
        key = fold(grams, [len(langs) + 1, *[len(words) + 1] * 3])
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key)
            grams, counts = [g[order] for g in grams], counts[order]
        depth = sum((g > 0).astype(np.int64) for g in grams) - 1
        new, arcs, at = np.zeros(len(counts), bool), [], []
        for d in range(4):
            new[:1] = True
            new[1:] |= grams[d][1:] != grams[d][:-1]
            rows = np.flatnonzero(new & (depth >= d))
            arcs.append((grams[d][rows], np.where(depth[rows] == d, counts[rows], 0)))
            at.append(rows)
        levels: list[tuple[np.ndarray, ...]] = []
        target = np.zeros(len(at[3]), np.int64)
        for d in (3, 2, 1, 0):
            # the arc of the level above that leads to each arc here
            parent = np.searchsorted(at[d - 1], at[d], side="right") - 1 if d else np.zeros(len(at[0]), np.int64)
            begin = _runs(np.diff(parent, prepend=-1) != 0)
            state, stands = _register(begin, [*arcs[d], target])
            size = np.diff(begin)[stands]
            pick = np.repeat(begin[:-1][stands] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            levels.insert(0, (size, arcs[d][0][pick], arcs[d][1][pick], target[pick]))
            if d:
                target = np.zeros(len(at[d - 1]), np.int64)
                target[parent[begin[:-1]]] = state + 1
        return cls(langs, words, levels)

    def to_bytes(self) -> bytes:
        parts, sizes = [], []
        for strings in (self.langs, self.words):
            buf, off = B.text_buffer(strings)
            parts += [buf, _least(np.diff(off))]
        parts += [_least(c) for level in self.levels for c in level]
        sizes = [(p.dtype.str, len(p)) for p in parts]
        raw = json.dumps(sizes).encode() + b"\n" + b"".join(p.tobytes() for p in parts)
        return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
        at = raw.index(b"\n") + 1
        parts = []
        for dtype, n in json.loads(raw[: at - 1]):
            parts.append(np.frombuffer(raw, dtype, n, at))
            at += parts[-1].nbytes
        langs, words = (_strings(parts[i], parts[i + 1].astype(np.int64)) for i in (0, 2))
        wide = [p.astype(np.int64) for p in parts[4:]]
        return cls(langs, words, [tuple(wide[4 * d : 4 * d + 4]) for d in range(4)])

    def grams(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Every n-gram and its count, in order."""
        # arcs are followed level by level, so shared states are written out again
        n, columns, held = 1, [], []
        states = np.zeros(1, np.int64)
        for size, symbol, weight, target in self.levels:
            begin = np.cumsum(size) - size
            if not len(size):
                break
            many = size[states]
            arc = np.repeat(begin[states] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            columns = [c[np.repeat(np.arange(n), many)] for c in columns] + [symbol[arc]]
            ends = weight[arc] > 0
            held.append(([c[ends] for c in columns], weight[arc][ends]))
            goes = target[arc] > 0
            columns, states = [c[goes] for c in columns], target[arc][goes] - 1
            n = len(states)
        out = [np.concatenate([c[i] if i < len(c) else np.zeros(len(w), np.int64) for c, w in held]) if held else np.zeros(0, np.int64) for i in range(4)]
        return out, np.concatenate([w for _, w in held]) if held else np.zeros(0, np.int64)

    def walk(self, langs: pa.Array, words: list[pa.Array]) -> np.ndarray:
        """The counts of n-grams given by language and up to three words (null beyond
        the end); 0 where the automaton does not hold one."""
        symbols = [pc.fill_null(pc.index_in(x, value_set=v), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for x, v in ((langs, self.langs), *((w, self.words) for w in words))]
        open_ = [np.ones(len(langs), bool), *(pc.is_valid(w).to_numpy(zero_copy_only=False) for w in words)]
        found, state, alive = np.zeros(len(langs), np.int64), np.zeros(len(langs), np.int64), np.ones(len(langs), bool)
        for d, (size, symbol, weight, target) in enumerate(self.levels[: len(symbols)]):
            go = open_[d]
            found[go] = 0
            alive &= go | ~alive
            base = (len(self.langs) if d == 0 else len(self.words)) + 1
            key = np.repeat(np.arange(len(size)), size) * base + symbol
            if not len(key):
                return np.where(go, 0, found)
            want = state * base + symbols[d]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = go & alive & (key[at] == want)
            found[hit] = weight[at[hit]]
            alive = np.where(go, hit & (target[at] > 0), False)
            state = np.where(alive, target[at] - 1, 0)
        return found


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in byte order, and each value's number among them from 1."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy().astype(np.int64)]


def _hashes(values: pa.Array) -> np.ndarray:
    buf, off = B.text_buffer(values)
    return B.span_hash(B.prefix_sums(B.byte_values()[buf]), off[:-1], off[1:])


def _ranges(langs: pa.Array, words: pa.Array, grams: list[np.ndarray], ranges: int) -> np.ndarray:
    """The prefix range of every n-gram; the same wherever it is counted."""
    lang, word = (np.concatenate([np.zeros(1, np.uint64), _hashes(v)]) for v in (langs, words))
    prefix = B.mix(lang[grams[0]] * U64(3) + B.mix(word[grams[1]]) * U64(5) + word[grams[2]])
    return ((prefix % U64(ranges) + word[grams[3]] % U64(SPREAD)) % U64(ranges)).astype(np.int64)


# ---------------------------------------------------------------- shards

def count_shard(texts: pa.Array, langs: pa.Array) -> tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]:
    """The sorted languages and words of a run of documents, and its n-grams as
    numbers into both with their counts."""
    buf, off = B.text_buffer(texts)
    buf = B.ascii_lower(buf)
    word = ~_GAP[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    edge[off[off < len(buf)]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = word[starts] if len(buf) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    words, w = _numbered(_strings(buf[word], ends - starts))
    names, lang = _numbered(pc.cast(langs, pa.large_binary()))
    doc = np.searchsorted(off, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(_PIECE_END[buf]), starts)
    joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    size = np.int64(len(words) + 1)

    one, at_one, n_one = np.unique(lang[doc] * size + w, return_inverse=True, return_counts=True)
    i = np.flatnonzero(joined)
    two, at, n_two = np.unique(at_one[i] * size + w[i + 1], return_inverse=True, return_counts=True)
    at_two = np.full(len(w), -1, np.int64)
    at_two[i] = at
    i = i[:-1][(i[1:] == i[:-1] + 1)]
    three, n_three = np.unique(at_two[i] * size + w[i + 2], return_counts=True)

    del buf, word, cuts, starts, ends, doc, piece, joined, w, at_one, at, at_two, i
    narrow = lambda x: x.astype(np.int32)
    heads, of_two, last_two = (narrow(one // size), narrow(one % size)), narrow(two // size), narrow(two % size)
    of_three = narrow(three // size)
    grams = [
        np.concatenate([heads[0], heads[0][of_two], heads[0][of_two[of_three]]]),
        np.concatenate([heads[1], heads[1][of_two], heads[1][of_two[of_three]]]),
        np.concatenate([np.zeros(len(one), np.int32), last_two, last_two[of_three]]),
        np.concatenate([np.zeros(len(one) + len(two), np.int32), narrow(three % size)]),
    ]
    return names, words, grams, np.concatenate([n_one, n_two, n_three])


def _narrowed(values: pa.Array, columns: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
    """Only the symbols that the columns use, numbered anew in the same order."""
    used = np.zeros(len(values) + 1, bool)
    for c in columns:
        used[c] = True
    used[0] = False
    number = np.cumsum(used)
    number[0] = 0
    return values.take(pa.array(np.flatnonzero(used) - 1)), [number[c] for c in columns]


def _shard_blobs(texts: list[pa.Array], langs: list[pa.Array], ranges: int) -> Iterator[pa.RecordBatch]:
    names, words, grams, counts = count_shard(pa.concat_arrays(texts), pa.concat_arrays(langs))
    at = _ranges(names, words, grams, ranges)
    order = np.argsort(at.astype(np.int32), kind="stable").astype(np.int32)
    cuts = _runs(np.diff(at[order], prepend=-1) != 0)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        pick = order[lo:hi]
        mine, (lang,) = _narrowed(names, [grams[0][pick]])
        vocabulary, columns = _narrowed(words, [g[pick] for g in grams[1:]])
        blob = Transducer.build(mine, vocabulary, [lang, *columns], counts[pick]).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([at[pick[0]]], pa.int32()), pa.array([blob], pa.binary())], ["range", "blob"])


def _shards(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0
        for batch in batches:
            text, lang = (pc.cast(batch.column(i), pa.large_string()) for i in (0, 1))
            off = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))])
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SHARD_BYTES - size, side="right")) - 1)
                texts.append(text.slice(lo, hi - lo))
                langs.append(lang.slice(lo, hi - lo))
                size += int(off[hi] - off[lo])
                lo = hi
                if size >= SHARD_BYTES or lo < len(text):
                    yield from _shard_blobs(texts, langs, ranges)
                    texts, langs, size = [], [], 0
        if size:
            yield from _shard_blobs(texts, langs, ranges)

    return run


# ---------------------------------------------------------------- union by range

class Union:
    """The sum of transducers, as distinct n-grams over a common vocabulary."""

    def __init__(self):
        self.parts: list[tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, t: Transducer) -> None:
        grams, counts = t.grams()
        self.parts.append((t.langs, t.words, grams, counts))
        self.size += len(counts)
        if self.size > _HELD and len(self.parts) > 1:
            self.parts = [self.sum()]
            self.size = len(self.parts[0][3])

    def sum(self) -> tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]:
        langs, words, grams, counts = zip(*self.parts, strict=True)
        names, lang = _numbered(pa.concat_arrays(list(langs)))
        vocabulary, word = _numbered(pa.concat_arrays(list(words)))
        columns = []
        for c in range(4):
            number, symbols = (lang, langs) if c == 0 else (word, words)
            at = np.cumsum([0, *map(len, symbols)])
            columns.append(np.concatenate([np.concatenate([[0], number[at[p] : at[p + 1]]])[g[c]] for p, g in enumerate(grams)]))
        key = fold(columns, [len(names) + 1, *[len(vocabulary) + 1] * 3])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1) != 0)
        n = np.concatenate(counts)[order]
        return names, vocabulary, [c[order[first]] for c in columns], np.add.reduceat(n, first) if len(first) else n

    def pruned(self, least: int) -> tuple[Transducer, dict[str, int]]:
        """The transducer of the n-grams with at least ``least`` occurrences, and the
        word occurrences of every language."""
        names, words, grams, counts = self.sum()
        ones = grams[2] == 0
        total = np.zeros(len(names) + 1, np.int64)
        np.add.at(total, grams[0][ones], counts[ones])
        keep = counts >= least
        mine, (lang,) = _narrowed(names, [grams[0][keep]])
        vocabulary, columns = _narrowed(words, [g[keep] for g in grams[1:]])
        n = {names[i - 1].as_py().decode(): int(total[i]) for i in np.flatnonzero(total)}
        return Transducer.build(mine, vocabulary, [lang, *columns], counts[keep]), n


def _unions(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(at: int, union: Union) -> pa.RecordBatch:
            t, n = union.pruned(least)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([t.to_bytes()], pa.binary()), pa.array([list(n)], pa.list_(pa.string())), pa.array([list(n.values())], pa.list_(pa.int64()))],
                ["range", "blob", "langs", "n"],
            )

        at, union = None, Union()
        for batch in batches:  # sorted by range
            for r, blob in zip(batch.column("range").to_pylist(), batch.column("blob"), strict=True):
                if r != at and at is not None:
                    yield done(at, union)
                    union = Union()
                at = r
                union.add(Transducer.from_bytes(blob.as_py()))
        if at is not None:
            yield done(at, union)

    return run


# ---------------------------------------------------------------- parts

_PARTS = "range int, salt int, lang string, phrase string, a long, k int, side int, p1 string, p2 string"


def _part_queries(ranges: int):
    """Both parts of every cut of every candidate, with the range that counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                t = Transducer.from_bytes(blob.as_py())
                grams, counts = t.grams()
                nothing = np.zeros(len(counts), np.int64)
                for n in (2, 3):
                    rows = np.flatnonzero((grams[2] > 0) & ((grams[3] > 0) == (n == 3)))
                    if not len(rows):
                        continue
                    lang, w = grams[0][rows], [g[rows] for g in grams[1 : n + 1]]
                    text = [t.words.take(pa.array(x - 1)).cast(pa.large_string()) for x in w]
                    phrase = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string()))
                    name = t.langs.take(pa.array(lang - 1)).cast(pa.large_string())
                    zero = nothing[: len(rows)]
                    salt = pa.array((_hashes(phrase) % U64(SALTS)).astype(np.int32))
                    for k in range(1, n):
                        for side, part in enumerate((range(k), range(k, n))):
                            i = list(part)
                            symbols = [lang, w[i[0]], w[i[1]] if len(i) == 2 else zero, zero]
                            at = _ranges(t.langs, t.words, symbols, ranges)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(at.astype(np.int32)), salt, name.cast(pa.string()), phrase.cast(pa.string()), pa.array(counts[rows]),
                                    pa.array(np.full(len(rows), k, np.int32)), pa.array(np.full(len(rows), side, np.int32)),
                                    text[i[0]].cast(pa.string()), text[i[1]].cast(pa.string()) if len(i) == 2 else pa.nulls(len(rows), pa.string()),
                                ],
                                [c.split()[0] for c in _PARTS.split(", ")],
                            )

    return run


def _compose(parts: pa.Table, ranges: pa.Table) -> pa.Table:
    keep = ["lang", "phrase", "a", "k", "side"]
    found = np.zeros(parts.num_rows, np.int64)
    if parts.num_rows and ranges.num_rows:
        t = Transducer.from_bytes(ranges.column("blob")[0].as_py())
        text = lambda c: pc.cast(pc.cast(parts.column(c).combine_chunks(), pa.large_string()), pa.large_binary())
        found = t.walk(text("lang"), [text("p1"), text("p2")])
    return parts.select(keep).append_column("f", pa.array(found))


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def count_transducers(docs: DataFrame, text_col: str, lang_col: str, least: int) -> tuple[DataFrame, int]:
    """One pruned transducer per prefix range, (range, blob, langs, n), and how many
    ranges there are."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(8, -(-int(size) // RANGE_BYTES))
    blobs = texts.filter("text != ''").mapInArrow(_shards(ranges), "range int, blob binary")
    merged = blobs.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_unions(least), "range int, blob binary, langs array<string>, n array<long>")
    return stage(merged, "collocations-ranges"), ranges


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = MIN_COUNT,
    top: int = TOP,
    covered: int = COVERED,
) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n,
    score.  A phrase inside a longer candidate that has at least ``covered`` per cent
    of its occurrences is dropped."""
    held, ranges = count_transducers(docs, text_col, lang_col, least)
    queries = held.select("blob").mapInArrow(_part_queries(ranges), _PARTS)
    copies = held.select("range", "blob").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = queries.groupBy("range", "salt").cogroup(copies.groupBy("range", "salt")).applyInArrow(_compose, "lang string, phrase string, a long, k int, side int, f long")
    part = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    whole = found.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *(part(k, s).alias(f"{'lr'[s]}{k}") for k in (1, 2) for s in (0, 1)))
    cuts = F.array(*(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)))
    whole = stage(whole.withColumn("cut", F.array_min(F.filter(cuts, lambda c: c["score"].isNotNull()))), "collocations-scored")
    inside = whole.filter("l2 is not null").select(
        "lang",
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("a") * 100 >= F.col("l2") * covered, F.substring_index("phrase", " ", 2)),
                    F.when(F.col("a") * 100 >= F.col("r1") * covered, F.substring_index("phrase", " ", -2)),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("phrase"),
    )
    kept = whole.join(inside.distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = top_k_per_group(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    n = held.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
