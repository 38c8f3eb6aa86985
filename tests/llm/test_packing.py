"""Packing: a full check of every sequence against ids from the tokenizer library."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicscope.llm import _tokens, packing
from topicscope.llm.queries import QUERIES

from ..conftest import SF_MID, SF_SMALL

PATH = _tokens.default_path("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def check(docs, out, capacity=packing.CAPACITY):
    """docs: (doc_id, text) list, ids may repeat; out: rows of pack."""
    want = Counter()
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs])):
        want[i, tuple([*ids, 1])] += 1
    # pieces of equal rows are interchangeable: compare multisets of pieces by (doc, start)
    ids_of = {}
    for (i, ids), n in want.items():
        ids_of.setdefault((i, len(ids)), []).extend([ids] * n)
    spans = {}
    for p in out:
        assert p.length > 0
        spans.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
        cands = ids_of[p.doc_id, p.doc_tokens]
        assert any(p.ids_crc32 == zlib.crc32(np.array(c[p.start : p.start + p.length], "<u4")) for c in cands)
    assert spans.keys() == ids_of.keys()
    for key, s in spans.items():
        copies = len(ids_of[key])
        cover = Counter(itertools.chain.from_iterable(range(a, a + n) for a, n in s))
        assert len(cover) == key[1] and set(cover.values()) == {copies}
    seqs = {}
    for p in out:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return seqs


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_every_id_lies_in_one_piece(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op13_packing"](spark, sf).collect()
    seqs = check(docs, out)
    tokens = sum(p.length for p in out)
    assert len(seqs) <= tokens // packing.CAPACITY + 11


def test_edges(spark):
    word = " token"
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, word * 2047), (4, word * 2048), (5, word * 9000), (6, "x<|endoftext|>y"), (6, "other text")]
    docs += [(7, "same " * 900)] * 40 + [(8 + i, "hot " * 1500) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("rest", F.lit(0)).repartition(5)
    check(docs, packing.pack(df).collect())
    assert packing.pack(df.filter("false")).collect() == []


def test_small_capacity_and_other_end_id(spark):
    docs = [(i, " w" * (i % 23)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check(docs, packing.pack(df, capacity=16).collect(), 16)


def test_tokens_equal_the_library(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "", "  \n\t ", "é漢\U0001f600", "\x00", "'s'S don't"]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}  {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 11 == 0]
    enc = _tokens.byte_level_encoder(PATH, True)
    for t, ids in zip(texts, library_ids(texts)):
        assert enc(t).tolist() == ids
    plain, table = _tokens.byte_level_encoder(PATH, False), _tokens.byte_level_bytes(PATH)
    for t in texts[:300] + texts[1000:1007]:
        ids = plain(t).tolist()
        assert 50256 not in ids and b"".join(table[i] for i in ids) == t.encode()


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=7), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_multiset_is_closest(count, target):
    took = packing.closest_multiset(count, target)
    assert all(took[x] <= count[x] for x in took)
    best = {0}
    for x, c in count.items():
        best |= {b + x * k for b in best for k in range(c + 1) if b + x * k <= target}
    assert sum(x * n for x, n in took.items()) == max(best)


def test_rules_do_not_grow_with_the_corpus():
    rng = random.Random(1)
    counts = {x: rng.randrange(1, 400) for x in range(1, 2048)}
    small = packing.minimum_bin_slack(counts)
    large = packing.minimum_bin_slack({x: c * 10_000 for x, c in counts.items()})
    hot = packing.minimum_bin_slack(counts | {1500: 10**9})
    assert max(len(p.length) for p in (small, large, hot)) < 40_000
    assert large.sequences >= 10_000 * (sum(x * c for x, c in counts.items()) // 2048)
