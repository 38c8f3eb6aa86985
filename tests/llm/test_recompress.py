"""Word-window dedup against brute force, and the consistency of recompression."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from topicscope.llm.recompress import dedup_report, recompressed


def brute(texts, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed,window,before,after", [(1, 35, 4, 8), (2, 12, 2, 4)])
def test_matches_brute_force(spark, seed, window, before, after):
    r = random.Random(seed)
    vocab = ["é", "b", "c", "dd", " ", "f\x00"]
    text = lambda lo, hi: "".join(r.choice(vocab) + r.choice(" \n\t ") for _ in range(r.randint(lo, hi)))
    passages = [text(20, 90) for _ in range(6)]
    texts = [None, "", "b", "b " * 200, "b c " * 100, "c " * 34, "c " * 35]
    for _ in range(80):
        p = r.choice(passages).split(" ")
        a = r.randint(0, len(p) // 3)
        texts.append(text(0, 20) + " " + " ".join(p[a : a + r.randint(3, len(p))]) + " " + text(0, 30))
    texts += r.sample(texts, 6)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, t int")
    got = {x.doc_id: tuple(x)[1:] for x in dedup_report(docs, window, before, after).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_decided_symbols_are_the_same_in_every_copy():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 6, 400).astype(np.uint64)
    whole = list(recompressed(words, np.zeros(400, int), 3))
    for cut in (37, 111):
        part = words[cut : cut + 150]
        for (at, nm, lo, hi), (at2, nm2, lo2, hi2) in zip(whole, recompressed(part, np.zeros(150, int), 3), strict=True):
            inside = lambda a, n, b, e, s: {(int(x) + s, int(y)) for x, y, u, v in zip(a, n, b, e, strict=True) if u + s >= cut and v + s <= cut + 150}
            assert inside(at, nm, lo, hi, 0) == inside(at2, nm2, lo2, hi2, cut)


def test_empty_table(spark):
    assert dedup_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
