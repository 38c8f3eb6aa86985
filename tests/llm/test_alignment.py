"""Tokenizer alignment against a plain computation over all tokens."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicscope.llm import _tokens, alignment
from topicscope.llm.queries import QUERIES

from ..conftest import SF_MID, SF_SMALL

A, B = _tokens.default_path("byte_bpe_50k.json"), _tokens.default_path("piece_bpe_32k.model")


def brute_force(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    signs = _tokens._byte_of_sign()
    byte_token = [p for p in range(sp.get_piece_size()) if sp.is_byte(p)]
    rows = []
    for i, text in docs:
        raw = (" " + (text or "")).encode()
        a = tok.encode(" " + (text or ""), add_special_tokens=False)
        ids_a, ids_b = a.ids, sp.encode(text or "")
        bytes_a = [bytes(signs[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(sp.id_to_piece(p)[3:5], 16)]) if p in byte_token else sp.id_to_piece(p).replace("▁", " ").encode() for p in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            rows.append((i, [], [], []))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, e = 0, []
            for p in parts:
                at += len(p)
                e.append(at)
            ends.append(e)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for hi in common:
            groups.append(([x for x, e in zip(ids_a, ends[0]) if lo < e <= hi], [x for x, e in zip(ids_b, ends[1]) if lo < e <= hi]) if len(common) < 400 else None)
            lo = hi
        if None in groups:  # the same by two pointers, for long texts
            groups, p, q = [], 0, 0
            for hi in common:
                p2, q2 = ends[0].index(hi, p) + 1, ends[1].index(hi, q) + 1
                groups.append((ids_a[p:p2], ids_b[q:q2]))
                p, q = p2, q2
        rows.append((i, ids_a, ids_b, groups))
    count = Counter((g[0][-1], g[1][-1]) for r in rows for g in r[3])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, ids_a, ids_b, groups in rows:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_alignment"](spark, sf)
    assert got.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert order(got.collect()) == order(brute_force(docs))


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "plain words"), (4, "other words"), (None, "plain words"), (5, "▁ marks"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (7, "tab\tnew\nline\r\n  two  spaces "), (8, "été 漢字 \U0001f600 é"), (9, "\x00\x01"), (10, "x" * 5000), (11, "word " * 3000),
] + [(100 + i, "the same text again") for i in range(40)]


@pytest.mark.parametrize("share,text_share", [(alignment.SHARE, alignment.TEXT_SHARE), (20, 3), (1, 1)])
def test_edges_and_both_join_ways(spark, share, text_share):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("pair", F.lit("x")).repartition(5)
    assert order(alignment.token_alignment(df, share=share, text_share=text_share).collect()) == order(brute_force(EDGES))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.token_alignment(df).collect() == []
    only = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.token_alignment(only).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
