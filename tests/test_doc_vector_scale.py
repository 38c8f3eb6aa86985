"""Steps of the document vector model that grow with the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicscope.functions import analyzers
from topicscope.operators import cooccurrence as CO
from topicscope.operators import svd
from topicscope.operators import vectors as V


class Held:
    """A broadcast value."""

    def __init__(self, value):
        self.value = value


def test_texts_are_cut_into_tokens_once(spark):
    from topicscope.plans.embedding_topics import DocVectorTopicModel

    cut = []
    analyzers.register_tokenizer("counted", lambda c: cut.append(1) or F.split(c, " "), replace=True)
    docs = spark.createDataFrame([(i, f"x{i % 3} y{i % 5} z{i % 2} x{i % 3}") for i in range(30)], "doc_id long, text string")
    model = DocVectorTopicModel(vector_size=3, n_components=2, min_points=3, window=2, cell_size=0.5, tokenizer="counted").fit(docs)
    assert model.words.count() == 10 and len(cut) == 1


@pytest.mark.parametrize("bound", [svd.BROADCAST_MATRIX_BYTES, 1])
def test_documents_from_blocks_equal_those_from_texts(spark, monkeypatch, bound):
    rows = [(1, "aa bb bb zz"), (2, None), (3, ""), (4, "zz zz"), (5, "cc ää aa"), (5, "bb"), (6, "aa bb bb zz"), (None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = spark.createDataFrame([("aa", [1.0, 2.0]), ("bb", [0.5, -1.0]), ("cc", [3.0, 0.1]), ("ää", [7.0, 7.0])], "term string, v array<double>")
    plain = lambda df: sorted((r.doc_id or -1, *r.embedding) for r in df.collect())
    want = plain(CO.folded(docs, words, 2))
    monkeypatch.setattr(svd, "BROADCAST_MATRIX_BYTES", bound)  # 1: a component at a time
    monkeypatch.setattr(CO, "ENTRIES", 2)
    got = plain(CO.folded_blocks(CO.token_blocks(docs), words, 2))
    assert [x[0] for x in got] == [x[0] for x in want]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_packed_rows_keep_large_counts():
    keys = np.array([(0 << 32) | 7, (0 << 32) | 70_000, (5 << 32) | 1, (5 << 32) | 2, (1_000_000 << 32) | 3])
    n = np.array([1, 254, 255, 70_000, 1 << 40])
    g, sizes, c, *counts = CO._unpacked_rows(pa.scalar(CO._packed_rows(keys, n)))
    assert g.tolist() == [0, 5, 1_000_000] and sizes.tolist() == [2, 2, 1] and c.tolist() == [7, 70_000, 1, 2, 3]
    assert CO._counts(*counts).tolist() == n.tolist()


def test_topic_words_are_searched_by_direction(monkeypatch):
    rng = np.random.default_rng(5)
    words, centres = rng.normal(size=(4000, 6)), rng.normal(size=(12, 6)).repeat(40, axis=0) + rng.normal(scale=0.02, size=(480, 6))
    words[::50] = 0.0
    words, centres = V._units(words), V._units(np.vstack([centres, np.zeros((1, 6))]))
    scored = []
    monkeypatch.setattr(V, "TERMS", 1500)
    largest = V._largest
    monkeypatch.setattr(V, "_largest", lambda keys, n: scored.append(keys.size) or largest(keys, n))
    groups = [(rows, V._units(centres[rows].mean(axis=0, keepdims=True))[0]) for rows in V._direction_groups(centres[:-1], 40)]
    groups = [(rows, mid, float(V._angles(centres[rows] @ mid).max())) for rows, mid in groups] + [(np.array([480]), np.zeros(6), np.inf)]
    names = pa.array([f"w{i:04d}" for i in range(4000)])
    batch = pa.RecordBatch.from_arrays([names, pa.array(words.tolist())], ["term", "v"])
    found = pa.Table.from_batches(V._closest(Held((np.arange(481), centres, groups)), 5)([batch])).to_pandas()
    for i, rows in found.groupby("label"):
        keys = np.floor(centres[i] @ words.T * 1e10 + 0.5)
        want = np.argsort(-keys, kind="stable")[:5]
        assert set(rows["term"]) == {f"w{j:04d}" for j in want}
    assert len(found) == 481 * 5 and sum(scored) < 481 * 4000 / 2  # not every word against every topic
