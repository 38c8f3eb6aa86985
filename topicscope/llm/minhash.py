"""Near-duplicate documents: MinHash candidates, exact links, components.

A document's set holds its distinct ``shingle``-word shingles of lower-cased
words (fewer words: the whole sequence is the only one).  Two documents are
linked when ``100 * |A & B| >= percent * |A | B|``.

1. Documents with equal sets form a class; one of each class goes on.
2. Minima under ``bands * rows`` universal hashes are banded; documents that
   agree in a band share a bucket.  At a similarity of 0.8, 28 bands of 4 miss
   a pair with a chance of 4e-7.
3. A bucket is tested against its hub, the least document.  What is then in
   several components is narrowed by a bound: a shingle that no other document
   of such buckets has cannot be shared, so a document with ``own`` of those
   shares at most ``n - own``.  Too few for any partner: it is done.  Then three
   more hubs, those with the least share of own shingles, are tested, and at
   last what is still apart: bucket and size class are joined on sizes and on a
   bitmap of each set.  A bit that one set has and the other has not is a shingle
   they do not share, so the bits in common bound the intersection from above.
   Pairs inside a component cannot change it and bounded ones cannot be linked,
   so no link between components is lost.
4. A pair passes if its sizes allow the similarity, then if its signatures
   agree in at least 0.62 of the minima (near five deviations below 0.8), then
   by intersecting the full sets.
5. Components come from alternating large-star and small-star.

Texts without words (null and empty too) have an empty set and link with
nothing; rows without an id get no component; repeated rows share a class.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 28, 4
HUBS = 3
AGREE = 0.62
MAP_WORDS = 32

_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary, map array<long>"


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The universal family x -> (a * x + b mod 2^64) >> 32."""
    i = np.arange(1, n + 1, dtype=np.uint64)
    return B.mix(i * B.U64(0xD1342543DE82EF95)) | B.U64(1), B.mix(i * B.U64(0xAF251AF3B0F025B5))


def _shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each document, and their offsets."""
    buf = B.ascii_lower(buf)
    starts, ends, woff = B.word_spans(buf, off)
    names = B.word_hashes(buf, starts, ends)
    prefix = B.prefix_sums(names)
    words = np.diff(woff)
    doc = np.repeat(np.arange(len(words)), words)
    at = np.arange(len(names))
    whole = at + k <= woff[doc + 1]
    short = woff[:-1][(words > 0) & (words < k)]
    first = np.concatenate([at[whole], short])
    last = np.concatenate([at[whole] + k, woff[1:][(words > 0) & (words < k)]])
    values, owner = B.span_hash(prefix, first, last), doc[first]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else np.zeros(0, bool)
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(words) + 1))


def _bitmaps(values: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Per document 64 * MAP_WORDS bits, each set if a shingle falls on it."""
    on = np.zeros((docs, 64 * MAP_WORDS), bool)
    on[owner, (B.mix(values + B.U64(5)) % B.U64(64 * MAP_WORDS)).astype(np.int64)] = True
    return np.packbits(on, axis=1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(rows.ravel()))


def _sign_batches(k: int, bands: int, rows: int):
    a, b = _family(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
                values, soff = _shingles(buf, off, k)
                n = np.diff(soff)
                full = np.flatnonzero(n)
                least = np.zeros((hi - lo, len(a)), np.uint64)
                keys = np.zeros((2, hi - lo), np.uint64)
                if len(full):
                    at = soff[:-1][full]
                    keys[0, full] = np.add.reduceat(B.mix(values), at)
                    keys[1, full] = np.add.reduceat(B.mix(values + B.U64(77)), at)
                    x, y = values >> B.U64(32), np.empty_like(values)
                    for i in range(len(a)):
                        np.multiply(x, a[i], out=y)
                        np.add(y, b[i], out=y)
                        least[full, i] = np.minimum.reduceat(y, at)
                least >>= B.U64(32)
                band = np.arange(bands, dtype=np.uint64)
                key = np.broadcast_to(band + B.U64(1), (hi - lo, bands)).copy()
                for r in range(rows):
                    key = B.mix(key * B.U64(0x9E3779B97F4A7C15) + least[:, r::rows])
                sig = least.astype(np.uint8)
                maps = _bitmaps(values, np.repeat(np.arange(hi - lo), n), hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), _lists(key.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()), _lists(maps)],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig", "map"],
                )

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
                values, soff = _shingles(buf, off, k)
                sets = [values[soff[i] : soff[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
            values = np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), d)), pa.array(values)], names=["doc_id", "shingle"])


def _agree_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("s1", "s2"))
            ok = pa.array((one == two).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _linked_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v))
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph by alternating large-star and
    small-star; ``component`` is the least node reachable.  Every round is staged
    and only counts and a checksum reach the driver."""
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, seen = B.stage(pair, "star"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = B.stage(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = B.stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "star")
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _links(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, agree: float) -> DataFrame:
    """Of the candidate pairs, those whose full sets are similar enough."""
    side = lambda n, s: signed.select(F.col("doc_id").alias(n), F.col("n_shingles").alias("n" + n), F.col("sig").alias(s))
    sized = pairs.join(side("a", "s1"), "a").join(side("b", "s2"), "b")
    sized = sized.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = sized.select("a", "b", "s1", "s2").mapInArrow(_agree_batches(agree), "a long, b long")
    full = likely.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(_linked_batches(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, hubs: int = HUBS, agree: float = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = B.stage(source.mapInArrow(_sign_batches(shingle, bands, rows), _SIGNED), "minhash-signed")
    key = ["n_shingles", "k1", "k2"]
    classes = B.stage(signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "minhash-classes")
    rep = signed.join(classes, key).filter("doc_id = rep").dropDuplicates(["doc_id"])
    rep = B.stage(rep.select("doc_id", "n_shingles", "bands", "sig", "map"), "minhash-reps")
    banded = rep.select(F.col("doc_id"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).filter("n > 1").drop("n")
    shared = B.stage(shared, "minhash-buckets")
    members = B.stage(banded.join(shared, "band"), "minhash-members")
    # sets of the documents that share a bucket
    busy = members.select("doc_id").distinct()
    sets = B.stage(source.join(busy, "doc_id").mapInArrow(_set_batches(shingle), "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "minhash-sets")
    facts = rep.select("doc_id", "n_shingles", "sig")
    first = members.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()
    links = B.stage(_links(first, facts, sets, percent, agree), "minhash-links")
    group = B.stage(components(links), "minhash-groups")

    def split(group: DataFrame) -> DataFrame:
        """Members of the buckets that several components share."""
        placed = members.join(group, members.doc_id == group.node, "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
        mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
        return B.stage(placed.join(B.stage(mixed, "minhash-mixed"), "band", "left_semi"), "minhash-split")

    open_ = split(group).select("band", "doc_id")
    # shingles that one document alone has, among all that might still be linked
    single = sets.join(B.stage(open_.distinct().select("doc_id").distinct(), "minhash-open"), "doc_id").mapInArrow(_one_by_one, "doc_id long, shingle long")
    single = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    own = single.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    # |A & B| >= s / (1 + s) * (|A| + |B|) and <= |A| - own: the largest partner
    share = F.col("n_shingles") - F.coalesce("own", F.lit(0))
    sized = rep.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", F.col("n_shingles").alias("n"), F.floor((100 + percent) * share / percent - F.col("n_shingles")).alias("most"))
    sized = sized.filter(100 * F.col("most") >= percent * F.col("n"))
    feasible = B.stage(open_.join(sized, "doc_id"), "minhash-feasible")
    # of each of ``hubs`` parts of a bucket the document with the least share of own shingles
    best = feasible.groupBy("band").agg(*[F.min(F.struct(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(hubs)) != r, F.col("n") / F.col("most"), F.col("doc_id"))).alias(f"h{r}") for r in range(hubs)])
    best = best.select("band", F.explode(F.array_distinct(F.array(*[F.col(f"h{r}.doc_id") for r in range(hubs)]))).alias("a"))
    place = group.select("node", F.col("component").alias("c"))
    placed = lambda df, doc, to: df.join(place, df[doc] == place.node, "left").withColumn(to, F.coalesce("c", doc)).drop("node", "c")
    second = feasible.select("band", F.col("doc_id").alias("b")).join(B.stage(best, "minhash-hubs"), "band").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = placed(placed(second, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    links = B.stage(links.unionByName(_links(second, facts, sets, percent, agree)), "minhash-links")
    group = B.stage(components(links), "minhash-groups")
    # what is still apart and possible: all but a bucket's largest component
    # against everything of another component, by size class
    place = group.select("node", F.col("component").alias("c"))
    open_ = B.stage(placed(feasible, "doc_id", "component").join(rep.select("doc_id", "bands", "map"), "doc_id"), "minhash-open")
    main = open_.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    main = B.stage(main.select("band", "main"), "minhash-main")
    size_class = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(float(np.log(1.12))))
    least = F.floor(percent * F.col("n") / 100)
    # shingles beyond the bits set: no set shares more than these and its common bits
    spare = F.col("n") - reduce(add, [F.bit_count(F.col("map")[i]) for i in range(MAP_WORDS)])
    minor = open_.join(main, "band").filter("component <> main").select("band", F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("bands").alias("ba"), F.col("map").alias("xa"), spare.alias("sa"), F.explode(F.sequence(size_class(least), size_class(F.col("most")))).alias("class"))
    other = open_.join(main.select("band"), "band", "left_semi").select("band", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("bands").alias("bb"), F.col("map").alias("xb"), spare.alias("sb"), size_class(F.col("n")).alias("class"))
    last = minor.join(other, ["band", "class"]).filter("ca <> cb and nb <= ma and na <= mb")
    # bits in common, and with them the largest intersection
    both = reduce(add, [F.bit_count(F.col("xa")[i].bitwiseAND(F.col("xb")[i])) for i in range(MAP_WORDS)])
    most = F.least("sa", "sb") + both
    last = last.filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    # a pair comes from the first band it shares only
    before = lambda c: F.slice(c, F.lit(1), F.array_position("ba", F.col("band")).cast("int") - 1)
    last = last.filter(~F.arrays_overlap(before("ba"), before("bb")))
    last = last.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = B.stage(links.unionByName(_links(last, facts, sets, percent, agree)), "minhash-links")
    group = B.stage(components(links), "minhash-groups")
    out = signed.select("doc_id", *key).join(classes, key, "left").join(group, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def kept_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, with all its columns.  Repeated rows of its id
    are one document; rows without an id cannot be grouped and stay."""
    stay = B.stage(near_duplicates(docs, shingle).filter("kept").select("doc_id").distinct(), "minhash-kept")
    named = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
