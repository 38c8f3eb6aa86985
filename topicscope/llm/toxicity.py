"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  Each is a sparse logistic model
over the presence of tokens and token beginnings (hashed); from the second on it
also sees the logits of the categories before it.  To train a later model, the
earlier probabilities come from models that did not see the row (``folds``
out-of-fold predictions); to score documents, from models of all training rows.

Training uses at most ``max_train`` labelled rows, drawn by a hash of the id, so
the fit on the driver is bounded; scoring covers whole texts of all documents.
The rejection threshold of a category is the one of best F1 on its out-of-fold
probabilities.

Null and empty texts have no features and get the models' base rate; labels
that are null are left out of training, repeated label rows count once, and
labels without a document count nothing.  Without labels of both kinds a
category's probability is their mean (0 without any) and nothing is rejected.
Extra columns are ignored (``kept`` keeps those of the documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

BITS = 18
PREFIX = 5
FEATURES = 3000
FOLDS = 3
MAX_TRAIN = 6000
# category -> how labels tell it; later ones see the earlier ones' logits
CATEGORIES: dict[str, Column | str] = {"low_quality": "1 - quality", "toxic": "toxic"}

_CLASS = np.full(256, 2, np.uint8)  # signs and digits
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x80:] = 1
for _a, _z in ((65, 91), (97, 123)):
    _CLASS[_a:_z] = 1


def token_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of every token and token beginning."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    kind = _CLASS[buf]
    edge = np.append(True, kind[1:] != kind[:-1])
    edge[off[(off > 0) & (off < len(buf))]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(buf))
    word = kind[start] > 0
    start, end = start[word], end[word]
    prefix = B.prefix_sums(B.byte_values()[B.ascii_lower(buf)])
    doc = np.searchsorted(off, start, side="right") - 1
    whole = B.span_hash(prefix, start, end)
    head = B.mix(B.span_hash(prefix, start, np.minimum(start + PREFIX, end)) + B.U64(5))
    both = np.concatenate([whole, head]) >> B.U64(64 - BITS)
    return np.concatenate([doc, doc]), both.astype(np.int32)


def _present(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document and their offsets."""
    doc, f = token_features(buf, off)
    key = np.unique(doc << BITS | f)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(off)))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
            f, at = _present(buf, off)
            rows = [f[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["y", "features"])


@dataclass
class Linear:
    """One category: weights over hashed features and over earlier logits."""

    name: str
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _telling(row: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features whose share differs most between the two kinds of rows."""
    pos = np.bincount(f[y[row] > 0], minlength=1 << BITS).astype(np.float64)
    neg = np.bincount(f[y[row] == 0], minlength=1 << BITS).astype(np.float64)
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float(len(y) - y.sum()))
    share = (pos + neg) / (n1 + n0)
    z = (pos / n1 - neg / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    z[pos + neg < 3] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    return best[np.abs(z[best]) > 2.5]


def fit_linear(row: np.ndarray, f: np.ndarray, extra: np.ndarray, y: np.ndarray, l1: float = 0.6, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """L1-regularised logistic regression by accelerated proximal steps."""
    chosen = _telling(row, f, y)
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    use = place[f] >= 0
    r, c = row[use], place[f[use]]
    n, d = len(y), len(chosen)
    k = extra.shape[1]
    w, v, t = np.zeros(d + k + 1), np.zeros(d + k + 1), 1.0
    # step from the largest row: a bound on the curvature that needs no search
    size = np.bincount(r, minlength=n) + (extra**2).sum(axis=1) + 1
    cols = np.bincount(c, minlength=d) if d else np.zeros(0)
    rate = 4.0 / max(1.0, np.sqrt(float(np.percentile(size, 99)) * float(max(cols.max(initial=1), n if k else 1))) * np.sqrt(n))
    penalty = np.append(np.full(d, l1), np.zeros(k + 1)) * rate
    for _ in range(steps):
        margin = np.bincount(r, weights=v[c], minlength=n) + extra @ v[d : d + k] + v[-1]
        miss = _sigmoid(margin) - y
        grad = np.concatenate([np.bincount(c, weights=miss[r], minlength=d), extra.T @ miss, [miss.sum()]])
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    out = np.zeros(1 << BITS)
    out[chosen] = w[:d]
    return out, w[d : d + k], float(w[-1])


def _margins(row: np.ndarray, f: np.ndarray, extra: np.ndarray, n: int, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    return np.bincount(row, weights=model[0][f], minlength=n) + extra @ model[1] + model[2]


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    after = p[order[at + 1]] if at + 1 < len(y) else 0.0
    return float((p[order[at]] + after) / 2)


def fit_chain(names: list[str], features: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """The chain of models from training rows given as feature lists."""
    n = len(features)
    row = np.repeat(np.arange(n), [len(x) for x in features])
    f = np.concatenate(features) if n else np.zeros(0, np.int32)
    fold = np.arange(n) % folds
    extra, chain = np.zeros((n, 0)), []
    for k, name in enumerate(names):
        y = labels[:, k].astype(np.float64) if n else np.zeros(0)
        if not 0 < y.sum() < n:
            p = float(y.mean()) if n else 0.0
            chain.append(Linear(name, np.zeros(1 << BITS), np.zeros(k), float(_logit(np.array(p))) if 0 < p < 1 else (30.0 if p else -30.0), 2.0))
            extra = np.column_stack([extra, np.full(n, chain[-1].bias)])
            continue
        held = np.zeros(n)
        for part in range(folds):
            inside = fold != part
            if not 0 < y[inside].sum() < inside.sum():
                held[~inside] = y[inside].mean()
                continue
            number = np.cumsum(inside) - 1
            mine = inside[row]
            model = fit_linear(number[row[mine]], f[mine], extra[inside], y[inside])
            out = ~inside
            held[out] = _sigmoid(_margins(row, f, extra, n, model))[out]
        w, earlier, bias = fit_linear(row, f, extra, y)
        chain.append(Linear(name, w, earlier, bias, _best_threshold(held, y)))
        extra = np.column_stack([extra, _logit(held)])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column | str] = CATEGORIES, max_train: int = MAX_TRAIN, folds: int = FOLDS) -> list[Linear]:
    """Fit the chain on at most ``max_train`` labelled documents."""
    told = [F.expr(c) if isinstance(c, str) else c for c in categories.values()]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*[c.cast("int") for c in told]).alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & ~F.exists("y", lambda x: x.isNull())).groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the sample is bounded by a parameter, so it may be broadcast
    rows = body.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").dropDuplicates(["doc_id"])
    got = rows.select(F.concat_ws(",", F.transform("y", lambda x: x.cast("string"))).alias("y"), "text").mapInArrow(_feature_batches, "y string, features binary").collect()
    # in an order that does not depend on partitions
    got = sorted(got, key=lambda r: (r.y, bytes(r.features)))
    shuffled = np.random.default_rng(7).permutation(len(got))
    got = [got[i] for i in shuffled]
    y = np.array([[int(v) for v in r.y.split(",")] for r in got]).reshape(len(got), len(categories))
    return fit_chain(list(categories), [np.frombuffer(r.features, np.int32) for r in got], y, folds)


def _score_batches(chain: list[Linear]):
    weights = [(m.weights.astype(np.float64), m.earlier, m.bias) for m in chain]
    nonzero = np.any([w != 0 for w, _, _ in weights], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
                doc, f = token_features(buf, off)
                tell = nonzero[f]
                key = np.unique(doc[tell] << BITS | f[tell])
                row, f = key >> BITS, key & ((1 << BITS) - 1)
                extra, out = np.zeros((hi - lo, 0)), []
                for model in weights:
                    p = _sigmoid(_margins(row, f, extra, hi - lo, model))
                    out.append(p)
                    extra = np.column_stack([extra, _logit(p)])
                part = batch.slice(lo, hi - lo)
                probs = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(out).ravel()), len(chain)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], probs], names=[*part.schema.names[:-1], "p"])

    return run


def _scored(docs: DataFrame, chain: list[Linear], carry: list[str]) -> DataFrame:
    """The ``carry`` columns as c0, c1 ... (names may clash) and ``p``."""
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    source = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    schema = source.drop("text").withColumn("p", F.lit(None).cast("array<double>")).schema
    return source.mapInArrow(_score_batches(chain), schema)


def _named(carry: list[str]) -> list[Column]:
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]


def scored(docs: DataFrame, chain: list[Linear], carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` with ``p``, the chain's probabilities."""
    return _scored(docs, chain, carry).select(*_named(carry), "p")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, one probability per category, and ``toxic``: whether it is rejected."""
    chain = train(docs, labels)
    out = scored(docs, chain, ["doc_id"])
    probs = [F.col("p")[i].alias(f"p_{m.name}") for i, m in enumerate(chain)]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *probs, (F.col("p")[len(chain) - 1] >= chain[-1].threshold).alias("toxic"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the last category does not reject, as they were."""
    chain = train(docs, labels)
    return _scored(docs, chain, docs.columns).filter(F.col("p")[len(chain) - 1] < chain[-1].threshold).select(*_named(docs.columns))
