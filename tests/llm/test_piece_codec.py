"""Streaming Viterbi against the full search, and exact round trips."""

import random

import pytest

from topicscope.llm import piece_codec as P


def full_search(vocab, text):
    """Best total score over all segmentations (quadratic table)."""
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - vocab.longest), j):
            hit = vocab.pieces.get(text[i:j])
            if hit:
                best[j] = max(best[j], best[i] + hit[1])
        if best[j] == float("-inf"):
            best[j] = best[j - 1] + vocab.byte_score * len(text[j - 1].encode())
    return best[-1]


def score(vocab, ids):
    back = {i: s for i, s in vocab.pieces.values()}
    return sum(back.get(i, vocab.byte_score) for i in ids)


@pytest.fixture(scope="module")
def toy():
    r = random.Random(1)
    words = {"".join(r.choice("ab ") for _ in range(r.randint(2, 6))) for _ in range(60)}
    pieces = {w: (300 + i, -r.uniform(0.1, 9)) for i, w in enumerate(sorted({*words, "a", "b", " "}))}
    return P.Vocabulary(pieces, list(range(256)))


def test_stream_finds_the_best_path_in_any_split(toy):
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("aabb é") for _ in range(r.randint(0, 60)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        ids = [x for out in P.stream(toy, parts, r.randint(1, 9)) for x in out]
        assert score(toy, ids) == pytest.approx(full_search(toy, text))
        assert b"".join(toy.decoder()[i] for i in ids).decode() == text


def test_commits_before_the_text_ends(toy):
    seen = 0

    def parts():
        nonlocal seen
        for _ in range(200):
            seen += 1
            yield "ab ba "

    first = next(P.stream(toy, parts()))
    assert first and seen < 20


def test_whole_vocabulary_round_trip(spark):
    vocab = P.load_vocabulary()
    assert vocab.stretches
    texts = [None, "", " ", "  two  spaces ", "\n\n x\r\n\ty", "l▁iteral ▁", "日本語 é ß \U0001f600", "Hello world's_end 2024!!", "#" * 500, "x" * 3000, "the the the"]
    rows = P.encoded(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int"), vocab)
    got = {r.doc_id: r for r in P.decoded(rows, vocab).collect()}
    for i, t in enumerate(texts):
        assert got[i].exact and got[i].text == (t or "") and got[i].n_ids == len(got[i].ids)
        whole = [x for out in P.stream(vocab, (" " + t,)) for x in out] if t else []
        assert score(vocab, got[i].ids) == pytest.approx(score(vocab, whole))
    assert P.encoded(spark.createDataFrame([], "doc_id long, text string"), vocab).collect() == []
