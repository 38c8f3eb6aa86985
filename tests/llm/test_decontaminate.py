"""Latent retrieval: recall against brute-force subsequences, and clean documents."""

import random

import numpy as np

from topicscope.llm import decontaminate as D

from ..conftest import SF_MID


def test_subsequence_length():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert D.common_subsequence(masks, len(a), b) == table[-1][-1]


def test_finds_planted_items_and_paraphrases_and_leaves_clean_documents(spark):
    r = random.Random(4)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").limit(300).collect()
    bench = spark.read.parquet(f"{SF_MID}/benchmark.parquet")
    items = bench.collect()
    vocab = [w for d in docs for w in d.text.split()]
    rows, planted = [], set()
    for i in range(150):
        words = [r.choice(vocab) for _ in range(r.randint(40, 300))]
        if i % 2:
            item = r.choice(items)
            put = item.text.split()
            if i % 4 == 1:  # every sixth word before the closing ones is another
                put = [r.choice(vocab) if k % 6 == 2 and k < len(put) - 6 else w for k, w in enumerate(put)]
            at = r.randint(0, len(words))
            words[at:at] = put
            planted.add((i, item.item_id))
        rows.append((i, " ".join(words), 0.0))
    rows += [(900, None, 0.0), (901, "", 0.0), (None, items[0].text, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share double")
    got = {(x.doc_id, x.item_id) for x in D.contamination_report(df, bench).collect()}
    assert len(planted & got) >= 0.95 * len(planted)
    assert not {d for d, _ in got} - {d for d, _ in planted} - {None}
    left = D.clean(df, bench).collect()
    assert {x.doc_id for x in left} >= {x for x, _, _ in rows if x is not None and x % 2 == 0 and x < 900} | {900, 901, None}
    assert D.clean(df, bench.limit(0)).count() == len(rows) and D.contamination_report(df.limit(0), bench).collect() == []


def test_svd_spans_the_top_singular_vectors(spark, monkeypatch):
    monkeypatch.setattr(D, "BITS", 6)
    rng = np.random.default_rng(2)
    counts = np.rint(60 * rng.random((40, 3)) @ rng.random((3, 64)) + rng.random((40, 64))).astype(np.uint8)
    idf = 1 + rng.random(64)
    a = counts * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rows = spark.createDataFrame([(np.arange(64, dtype=np.uint16).tobytes(), x.tobytes(), 1.0) for x in counts], "terms binary, counts binary, weight double")
    got = D.latent_terms(rows, idf, rank=3, over=5, power=2) / idf[:, None]
    u, s, vt = np.linalg.svd(a)
    want = vt[:3].T / s[:3]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 0.02 * np.abs(want).max()


def test_recall_in_bands_against_brute_force_windows(spark):
    """Short exact items, and paraphrases down to a share of 0.55, that the check
    accepts in some window are found, at least nine of ten in each band."""
    r = random.Random(6)
    docs = [x.text.split() for x in spark.read.parquet(f"{SF_MID}/documents.parquet").filter("text is not null").collect()]
    texts = [x.text.split() for x in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    vocab = [w for d in docs for w in d]
    rows, items, band = [(i, " ".join(d)) for i, d in enumerate(docs)], [], {}
    places = r.sample([i for i, d in enumerate(docs) if 30 < len(d) < 600], 120)
    for kind in (1, 2, 4, 6, 12, 0.55):
        for words in r.sample(texts, 20):
            at = r.randint(0, len(words) - kind) if kind >= 1 else 0
            item = words[at : at + kind] if kind >= 1 else words
            put = list(item)
            if kind < 1:
                for k in r.sample(range(len(put) - 6), min(len(put) - 6, round(len(put) * (1 - kind)))):
                    put[k] = r.choice(vocab)
            i = places[len(items)]
            at = r.randint(0, len(docs[i]))
            rows[i] = (i, " ".join(docs[i][:at] + put + docs[i][at:]))
            band.setdefault(kind, []).append((i, len(items)))
            items.append((len(items), " ".join(item)))
    got = {(x.doc_id, x.item_id) for x in D.contamination_report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def hashes(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return D.tokens(buf, np.array([0, len(buf)]))[0].tolist()

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    def accepted(item, doc):
        """Over the windows of the item's length at every token."""
        n, tail = len(item), item[-min(6, len(item)) :]
        for s in range(max(1, len(doc) - n + 1)):
            near = doc[s : s + n]
            if len(set(near) & set(item)) * 4 < len(set(item)):
                continue
            share = longest(item, near) / n
            if share >= 0.75 or (share >= 0.5 and longest(tail, near) >= 0.8 * len(tail)):
                return True
        return False

    for kind, of in band.items():
        want = [(i, k) for i, k in of if hashes(items[k][1]) and accepted(hashes(items[k][1]), hashes(rows[i][1]))]
        assert len(want) > 15 and len(got & set(want)) >= 0.9 * len(want), kind


def test_svd_is_fitted_on_every_passage(spark, monkeypatch):
    seen, fit = [], D.latent_terms
    monkeypatch.setattr(D, "latent_terms", lambda rows, *a, **b: (seen.append(rows.count()), fit(rows, *a, **b))[1])
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([0, 1, 64, 65, 700])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w4x3 w4x4 w4x5 w4x6"), (2, "")], "item_id long, text string")
    got = D.contamination_report(docs, bench).collect()
    assert seen == [0 + 1 + 1 + 2 + 11 + 1] and [(x.doc_id, x.item_id, x.share) for x in got] == [(4, 1, 1.0)]


def test_a_benchmark_over_the_bounds_is_searched_in_blocks(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF_MID}/benchmark.parquet").limit(12)
    texts = [x.text for x in bench.collect()]
    docs = spark.createDataFrame([(i, f"{t} and {texts[i - 1]}") for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(tuple, D.contamination_report(docs, bench).collect()))
    for bounds in ((5, 2_000_000), (20_000, 100)):
        monkeypatch.setattr(D, "MAX_ITEMS", bounds[0])
        monkeypatch.setattr(D, "MAX_TOKENS", bounds[1])
        assert len(D.item_blocks(bench, np.ones((1 << D.BITS, 2), np.float32))) > 2
        assert sorted(map(tuple, D.contamination_report(docs, bench).collect())) == want and len(want) >= 24
