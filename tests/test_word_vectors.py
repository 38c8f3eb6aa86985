"""Word vectors from counts against NumPy, and named tokenizers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicscope.functions import analyzers
from topicscope.operators import cooccurrence as CO
from topicscope.operators import svd

WORDS = "aa bb cc dd ee ff gg hh ii jj kk ll".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, weights=range(1, 13), k=rng.randrange(0, 30)))) for i in range(n)]
    return docs + [(900, None), (901, "zz"), (902, "aa aa aa"), (903, "")]


def plain_pairs(docs, window, min_count):
    toks = {i: (t or "").split() for i, t in docs}
    n = Counter(w for t in toks.values() for w in t)
    out = Counter()
    for t in toks.values():
        for i, a in enumerate(t):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if i != j and n[a] >= min_count and n[t[j]] >= min_count:
                    out[a, t[j]] += 1
    return out


@pytest.mark.parametrize("window,min_count", [(1, 1), (3, 20)])
def test_pair_counts_and_ppmi(spark, window, min_count):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = plain_pairs(docs, window, min_count)
    pairs = CO.pair_counts(df, window, min_count).checkpoint()
    assert {(r.term, r.context): r.n for r in pairs.collect()} == dict(want)
    rows = Counter()
    for (a, _), n in want.items():
        rows[a] += n
    total = sum(n**0.75 for n in rows.values())
    w = {(a, b): math.log(n * total / (rows[a] * rows[b] ** 0.75)) - math.log(2) for (a, b), n in want.items()}
    got = {(r.term, r.context): r.w for r in CO.ppmi(pairs, shift=2.0).collect()}
    assert got.keys() == {k for k, v in w.items() if v > 0}
    assert all(math.isclose(got[k], w[k], abs_tol=1e-9) for k in got)
    with pytest.raises(ValueError):
        CO.pair_counts(df, 0)


def test_vectors_span_the_leading_subspace(spark):
    docs = corpus(2, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    pairs = CO.ppmi(CO.pair_counts(df, 2, 2))
    terms = sorted({r.term for r in pairs.collect()})
    m = np.zeros((len(terms), len(terms)))
    for r in pairs.collect():
        m[terms.index(r.term), terms.index(r.context)] = r.w
    _, s, vt = np.linalg.svd(m)
    got = {r.term: np.array(r.v) for r in CO.word_vectors(df, 4, 2, 2, seed=3, n_iter=6).collect()}
    assert sorted(got) == terms
    v = np.array([got[t] for t in terms])
    np.testing.assert_allclose(np.linalg.norm(v, axis=0) ** 2, s[:4], rtol=1e-4)
    np.testing.assert_allclose(np.abs(np.sum((v / np.sqrt(s[:4])) * vt[:4].T, axis=0)), 1, atol=1e-3)
    none = CO.word_vectors(df.filter("doc_id = 903"), 4, 2, 1)
    assert none.collect() == [] and [list(r.embedding) for r in CO.folded(df.filter("doc_id = 903"), none, 4).collect()] == [[0.0] * 4]


@pytest.mark.parametrize("bound", [svd.BROADCAST_MATRIX_BYTES, 0])
def test_documents_are_means_of_their_words(spark, monkeypatch, bound):
    monkeypatch.setattr(svd, "BROADCAST_MATRIX_BYTES", bound)  # 0: frequent words broadcast, the others joined
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = {w: [float(i), float(i * i), -1.0] for i, w in enumerate(WORDS[:9])}
    words = spark.createDataFrame(list(known.items()), "term string, v array<double>")
    got = {r.doc_id: list(r.embedding) for r in CO.folded(df, words, 3, share=12).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        v = [known[w] for w in (t or "").split() if w in known]
        np.testing.assert_allclose(got[i], np.mean(v, axis=0) if v else [0.0] * 3, atol=1e-9)


def test_tokenizers_are_found_by_name(spark, scratch):
    from topicscope.plans.embedding_topics import DocVectorTopicModel
    from topicscope.plans.topics import TfidfTopicModel

    docs = spark.createDataFrame([(i, f"x-{i % 3} y-{i % 5},z-{i % 2} x-{i % 3}") for i in range(30)], "doc_id long, text string")
    with pytest.raises(ValueError):
        TfidfTopicModel(tokenizer="by comma").fit(docs)
    analyzers.register_tokenizer("by comma", lambda c: F.split(c, "[ ,]"))
    with pytest.raises(ValueError):
        analyzers.register_tokenizer("by comma", lambda c: F.split(c, " "))
    m = TfidfTopicModel(tokenizer="by comma", stop_words=None, n_components=3, n_clusters=2, random_state=1).fit(docs)
    assert {r["term"] for r in m.vocab.collect()} == {f"x-{i}" for i in range(3)} | {f"y-{i}" for i in range(5)} | {"z-0", "z-1"}
    m.save(f"{scratch}/m")
    back = TfidfTopicModel.load(spark, f"{scratch}/m")
    assert back.config["tokenizer"] == "by comma"
    assert sorted(map(tuple, back.predict(docs).collect())) == sorted(map(tuple, m.predict(docs).collect()))
    d = DocVectorTopicModel(vector_size=3, n_components=2, min_points=3, window=2, cell_size=0.5, tokenizer="by comma").fit(docs)
    assert {r["term"] for r in d.words.collect()} <= {r["term"] for r in m.vocab.collect()}


@pytest.mark.parametrize("bound", [CO.MAX_HINTED_BROADCAST_ROWS, 0])
def test_numbered_pairs_with_and_without_a_broadcast_vocabulary(spark, monkeypatch, bound):
    monkeypatch.setattr(CO, "MAX_HINTED_BROADCAST_ROWS", bound)
    monkeypatch.setattr(CO, "PAIRS", 7)  # passed on many times a task
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    terms = CO.numbered_vocabulary(df, 20)
    number = {r.term: r.idx for r in terms.collect()}
    assert sorted(number, key=number.get) == sorted(number) and sorted(number.values()) == list(range(len(number)))
    got = {(r.term, r.context): r.n for r in CO.numbered_pairs(df, terms, 3).collect()}
    assert got == {(number[a], number[b]): n for (a, b), n in plain_pairs(docs, 3, 20).items()}


def test_packed_passes_find_the_vectors_of_the_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.3)
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    x = spark.createDataFrame(rows, "doc_id long, idx int, w double").repartition(3)
    z = rng.normal(size=(30, 4))
    monkeypatch.setattr(svd, "ROWS", 7)
    np.testing.assert_allclose(svd._normal_pass(svd.packed_rows(x), z), m.T @ (m @ z), atol=1e-9)
    v, s = svd.randomized_svd(x, 30, 3, seed=1)
    monkeypatch.setattr(svd, "DENSE_BYTES", 0)  # the joins
    w, t = svd.randomized_svd(x, 30, 3, seed=1)
    np.testing.assert_allclose(s, t, rtol=1e-6)
    np.testing.assert_allclose(svd._dense(v, 30, 3), svd._dense(w, 30, 3), atol=1e-6)


@pytest.mark.parametrize("window,min_count,shift", [(3, 1, 1.0), (1, 1, 40.0)])
def test_vectors_from_lists_equal_those_of_the_joins(spark, monkeypatch, window, min_count, shift):
    docs = corpus(6, 90) + [(950, "only only"), (951, "ll ll ll ll")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    terms = CO.numbered_vocabulary(df, min_count)
    number = {r.term: r.idx for r in terms.collect()}
    for name, value in (("KEYS", 30), ("LIST", 2), ("ROWS", 5), ("ENTRIES", 3)):
        monkeypatch.setattr(CO, name, value)
    want = Counter({(number[a], number[b]): n for (a, b), n in plain_pairs(docs, window, min_count).items()})
    for share in (1, 12, 10**9):  # no word, some, all are frequent
        rows = CO.pair_rows(df, terms, window, share=share).collect()
        assert len({r.term for r in rows}) == len(rows)
        assert {(r.term, c): n for r in rows for c, n in zip(r.c, r.n, strict=True)} == want
    got = {r.term: list(r.v) for r in CO.word_vectors(df, 4, window, min_count, shift, seed=3, n_iter=1).collect()}
    monkeypatch.setattr(svd, "DENSE_BYTES", 2 * 8 * len(number))  # two columns at once
    few = {r.term: list(r.v) for r in CO.word_vectors(df, 4, window, min_count, shift, seed=3, n_iter=1).collect()}
    monkeypatch.setattr(CO, "HELD_BYTES", 0)  # the joins
    plain = {r.term: list(r.v) for r in CO.word_vectors(df, 4, window, min_count, shift, seed=3, n_iter=1).collect()}
    assert got.keys() == few.keys() == plain.keys()
    for term, v in plain.items():
        np.testing.assert_allclose(np.abs(got[term]), np.abs(v), atol=1e-5)
        np.testing.assert_allclose(few[term], got[term], atol=1e-9)


def test_topic_words_are_the_closest_of_all(spark, monkeypatch):
    from topicscope.operators import vectors as V

    monkeypatch.setattr(V, "TERMS", 4)
    rng = np.random.default_rng(8)
    words = {f"w{i:02d}": rng.integers(-2, 3, 3).astype(float) for i in range(60)}  # many equal directions
    topics = {i: rng.integers(-2, 3, 3).astype(float) for i in range(7)} | {7: np.zeros(3)}
    df = spark.createDataFrame([(w, v.tolist()) for w, v in words.items()], "term string, v array<double>").repartition(3)
    centres = spark.createDataFrame([(i, v.tolist(), 1) for i, v in topics.items()], "label int, center array<double>, size long")
    rows = V.closest_terms(df, centres, 4).collect()
    assert len(rows) <= 3 * 4 * len(topics)  # of each of 3 tasks, not of each word
    cosine = lambda a, b: round(float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), 10) if a.any() and b.any() else 0.0
    for label, c in topics.items():
        found = sorted((-round(r.weight, 10), r.term) for r in rows if r.label == label)[:4]
        want = sorted((-cosine(v, c), w) for w, v in words.items())[:4]
        assert [w for _, w in found] == [w for _, w in want]
        np.testing.assert_allclose([x for x, _ in found], [x for x, _ in want], atol=1e-9)
    assert V.closest_terms(df, centres.limit(0), 4).collect() == []


def test_copies_have_equal_vectors(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=40)) for _ in range(5)]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "doc_id long, text string").repartition(7)
    words = spark.createDataFrame([(w, [rng.gauss(0, 1), rng.gauss(0, 1)]) for w in WORDS], "term string, v array<double>")
    rows = CO.folded(df, words, 2).collect()
    assert len(rows) == 100 and len({(r.doc_id % 5, *r.embedding) for r in rows}) == 5
