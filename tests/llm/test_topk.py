"""Exact top-k against a full sort, with ties, repeats and unusable vectors."""

import math
import random

import pytest

from topicscope.llm import topk


def brute(rows, k, every, scale=256):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(scale * x) for x in v]
    out = []
    for q, v in ok.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,big", [(3, 1.0), (400, 1.0), (150, 1e6)])
def test_matches_full_sort(spark, monkeypatch, n, big):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    r = random.Random(n)
    common = [r.uniform(-1, 1) for _ in range(6)]
    rows = [(i, common if r.random() < 0.3 else [r.uniform(-1, 1) * big for _ in range(6)]) for i in range(n)]
    rows += [(None, common), (10_000, None), (10_010, []), (10_020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (10_030, [math.nan] + common[1:]), (10_040, [math.inf] + common[1:])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.exact_top_k(df, 5, 10).collect()))
    assert got == brute(rows, 5, 10)


def test_different_vectors_of_one_query_id_pool_their_scores(spark):
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-9, 9)) for _ in range(4)]) for i in range(1, 20)]
    asked = [(0, [1.0, 2.0, -3.0, 4.0]), (0, [-4.0, 1.0, 1.0, 0.5]), (0, [-4.0, 1.0, 1.0, 0.5])]
    df = spark.createDataFrame(rows + asked, "vec_id long, embedding array<double>")
    pool = sorted((-int(sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(q, v, strict=True))), i) for _, q in asked[:2] for i, v in rows)[:5]
    assert sorted(map(tuple, topk.exact_top_k(df, 5, 50).collect())) == [(0, k + 1, i, -s) for k, (s, i) in enumerate(pool)]


def test_scores_beyond_62_bits_are_refused(spark):
    with pytest.raises(ValueError):
        topk.exact_top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"))


def test_empty(spark):
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
