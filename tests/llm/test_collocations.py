"""Collocations against a plain count, and the automata on their own."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicscope.llm import collocations as C

from ..conftest import SF_SMALL


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_force(docs, least=10, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = [q for q in cand if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
            if not any(100 * cand[q] >= covered * a for q in longer):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def words(rng, n, v=12):
    return " ".join(rng.choice(["ab", "Ab", "c", "dé", "漢", "the", "x1", "\x01", "A.", "b,", "end!", "\n", "\t", "ﬁ"][:v]) for _ in range(n))


@pytest.mark.parametrize("shard,ranges", [(1 << 24, 12 << 20), (200, 100)])
def test_equals_the_plain_count(spark, monkeypatch, shard, ranges):
    monkeypatch.setattr(C, "RANGE_BYTES", ranges)
    rng = random.Random(3)
    docs = [(words(rng, rng.randrange(0, 60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    docs += [(None, "en"), ("", None), ("one", "xx"), ("hot pair " * 200, "en"), ("tail " + words(rng, 4000), "en"), ("a b c. " * 30, "fr")]
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("range", F.lit(2)).repartition(6)
    blobs = df.select("text", "lang").withColumn("lang", F.coalesce("lang", F.lit("und")))
    if shard < 1000:  # many shards a task: the same sums from more automata
        def shards(batches):
            C.SHARD_BYTES = shard
            yield from C._shards(8)(batches)

        rows = blobs.filter("text != ''").mapInArrow(shards, "range int, blob binary").collect()
        assert len(rows) > 8 * 6
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == brute_force(docs)
    assert sorted(tuple(r) for r in C.collocations(df, least=3, top=7, covered=90).collect()) == brute_force(docs, 3, 7, 90)


def test_empty_and_blank_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(df).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en"), (". , !", "en")], "text string, lang string")).collect() == []


def test_large_counts_do_not_overflow(spark):
    row = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 4_000_000_000)], "a long, l long, r long")
    got = row.select(C._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert got == 10**6 * 3_000_000_000**2 // (3_000_000_001 * 4_000_000_000)


def random_grams(rng, n):
    rows = sorted({tuple([rng.randrange(1, 3), rng.randrange(1, 9), *sorted([rng.randrange(0, 9), rng.randrange(0, 9)], key=lambda x: x == 0)]) for _ in range(n)})
    cols = [np.array(c, np.int64) for c in zip(*rows)]
    return cols, np.array([rng.randrange(1, 4) for _ in rows], np.int64)


def test_transducer_round_trip_lookup_and_sharing():
    rng = random.Random(5)
    langs = pa.array([b"de", b"en"], pa.large_binary())
    vocabulary = pa.array([bytes([97 + i]) for i in range(8)], pa.large_binary())
    for n in (1, 5, 300):
        grams, counts = random_grams(rng, n)
        t = C.Transducer.from_bytes(C.Transducer.build(langs, vocabulary, grams, counts).to_bytes())
        got, weight = t.grams()
        want = sorted((*g, c) for *g, c in zip(*grams, counts))
        assert sorted((*g, c) for *g, c in zip(*got, weight)) == want
        known = {tuple(x[:4]): x[4] for x in want}
        ask = [(a, b, c, d) for a in (1, 2) for b in range(1, 9) for c in range(9) for d in range(9) if c or not d]
        column = lambda k: pa.array([vocabulary[q[k] - 1].as_py() if q[k] else None for q in ask], pa.large_binary())
        found = t.walk(pa.array([langs[q[0] - 1].as_py() for q in ask], pa.large_binary()), [column(1), column(2), column(3)])
        assert found.tolist() == [known.get(q, 0) for q in ask]
        for size, *arcs in t.levels:  # no two states of a level are equal
            ends = np.cumsum(size)
            states = [tuple(tuple(c[e - s : e]) for c in arcs) for s, e in zip(size, ends)]
            assert len(set(states)) == len(states)
    none = t.walk(pa.array([b"xx"], pa.large_binary()), [pa.array([b"a"], pa.large_binary()), pa.nulls(1, pa.large_binary())])
    assert none.tolist() == [0]


def test_fold_orders_rows_beyond_64_bits():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 5, 500) * (1 << 29) for _ in range(4)]
    key = C.fold(cols, [1 << 32] * 4)
    rows = list(zip(*cols))
    order = sorted(range(500), key=lambda i: rows[i])
    assert all((key[a] < key[b]) == (rows[a] < rows[b]) for a, b in zip(order, order[1:]))


def test_whole_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", "lang").collect()]
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == brute_force(docs)
