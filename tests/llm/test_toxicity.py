"""The classifier chain: held-out accuracy and defined results at the edges."""

import os

import numpy as np

from topicscope.llm import toxicity as T

from ..conftest import SF_SMALL


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1") else SF_SMALL
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    chain = T.train(docs, half)
    assert [m.name for m in chain] == ["low_quality", "toxic"] and len(chain[1].earlier) == 1
    got = T.scored(docs, chain, ["doc_id"]).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("p", "toxic").collect()
    said = np.array([r.p[1] >= chain[1].threshold for r in got])
    truth = np.array([r.toxic > 0 for r in got])
    assert (said & truth).sum() >= 0.85 * truth.sum() and (said & ~truth).sum() <= 0.02 * (~truth).sum()


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    seen = []
    real = T.fit_linear
    monkeypatch.setattr(T, "fit_linear", lambda row, f, extra, y: seen.append((len(y), extra.copy())) or real(row, f, extra, y))
    rng = np.random.default_rng(1)
    feats = [np.unique(rng.integers(0, 50, 12)).astype(np.int32) for _ in range(90)]
    y = np.array([[int(3 in f), int(3 in f or 7 in f)] for f in feats])
    T.fit_chain(["a", "b"], feats, y, folds=3)
    assert [n for n, _ in seen] == [60, 60, 60, 90, 60, 60, 60, 90] and [e.shape[1] for _, e in seen] == [0] * 4 + [1] * 4


def test_nulls_repeats_one_kind_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, "x y", 7)], "doc_id long, text string, p int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 0, 1), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = T.toxicity_report(docs, labels).collect()
    assert len(out) == 4 and not any(r.toxic for r in out) and {r.p_toxic for r in out} <= {r.p_toxic for r in out if r.p_toxic < 1e-3}
    assert sorted(T.kept(docs, labels).collect(), key=str) == sorted(docs.collect(), key=str)
    assert T.toxicity_report(docs.limit(0), labels.limit(0)).collect() == []


def plain_features(text):
    """Tokens and their first bytes, by walking the text byte by byte."""
    kind = lambda b: 0 if b in b"\t\n\x0b\x0c\r " else 1 if b >= 0x80 or chr(b).isalpha() else 2
    raw, out, i = (text or "").encode(), set(), 0
    while i < len(raw):
        j = i
        while j < len(raw) and kind(raw[j]) == kind(raw[i]):
            j += 1
        if kind(raw[i]):
            token = bytes(b + 32 if 65 <= b <= 90 else b for b in raw[i:j])
            out |= {(0, token), (1, token[: T.PREFIX])}
        i = j
    return out


def plain_fit(x, extra, y, l1=0.6):
    """The same penalised loss by small plain steps, run until nothing moves."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    pos, neg = x[y > 0].sum(axis=0), x[y == 0].sum(axis=0)
    share = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    use = (pos + neg >= 3) & (np.abs(z) > 2.5)
    full = np.column_stack([x * use, extra, np.ones(len(y))])
    step = 4 / np.linalg.norm(full, 2) ** 2
    w, penalty = np.zeros(full.shape[1]), np.concatenate([np.full(x.shape[1], l1), np.zeros(extra.shape[1] + 1)]) * step
    for _ in range(30_000):
        new = w - step * full.T @ (1 / (1 + np.exp(-np.clip(full @ w, -30, 30))) - y)
        new = np.sign(new) * np.maximum(np.abs(new) - penalty, 0)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return lambda a, e: 1 / (1 + np.exp(-np.clip(np.column_stack([a * use, e, np.ones(len(a))]) @ w, -30, 30)))


def test_decisions_equal_a_plain_chain(spark):
    rng = np.random.default_rng(5)
    common = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(420):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.4
        words = list(rng.choice(common, rng.integers(8, 30)))
        words += list(rng.choice(["Vile", "nasty", "hateful!"], rng.integers(1, 4))) if toxic else []
        words += ["click", "here"] if poor and rng.random() < 0.9 else []
        words += ["vile"] if rng.random() < 0.03 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(not poor), int(toxic)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: bool(r.toxic) for r in T.toxicity_report(docs, told).collect()}

    order = []  # the training order of the operator: by labels and features, then one fixed permutation
    for i, quality, toxic in labels:
        buf = np.frombuffer(rows[i][1].encode(), np.uint8)
        order.append((f"{1 - quality},{toxic}", T._present(buf, np.array([0, len(buf)]))[0].tobytes(), i))
    order = [i for *_, i in sorted(order)]
    order = [order[k] for k in np.random.default_rng(7).permutation(len(order))]
    sets = [plain_features(t) for _, t in rows]
    names = sorted(set().union(*sets))
    x = np.array([[float(f in s) for f in names] for s in sets])
    fold, extra, every = np.arange(len(order)) % T.FOLDS, np.zeros((len(order), 0)), np.zeros((len(rows), 0))
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    for column in (lambda q, t: 1 - q, lambda q, t: t):
        y = np.array([float(column(*labels[i][1:])) for i in order])
        held = np.zeros(len(y))
        for k in range(T.FOLDS):
            model = plain_fit(x[order][fold != k], extra[fold != k], y[fold != k])
            held[fold == k] = model(x[order][fold == k], extra[fold == k])
        p = plain_fit(x[order], extra, y)(x, every)
        extra, every = np.column_stack([extra, logit(held)]), np.column_stack([every, logit(p)])
    f1 = lambda cut: 2 * ((held >= cut) & (y > 0)).sum() / ((held >= cut).sum() + y.sum())
    best = max(sorted(set(held), reverse=True), key=f1)  # every cut is tried
    under = max([h for h in held if h < best], default=0.0)
    want = p >= (best + under) / 2
    differ = [i for i in range(len(rows)) if got[i] != want[i]]
    assert sum(want) > 80 and len(differ) <= 4, differ
