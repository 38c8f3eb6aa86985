"""Vector queries over embeddings and topic centres.

Centres are model state: at most ``k`` rows of ``d`` numbers.  They are packed
into one array (or map) by a scalar subquery, which Spark evaluates once and
ships with the task as a constant; every document is then scored with
higher-order functions in a projection.  No join and no pair table is built:
the work is ``n x k`` distance evaluations, streamed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, distance, vector_literal


def topic_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``label, center array<double>, size`` - mean vector per label.

    ``Summarizer`` is a typed, partially aggregated vector mean: one pass, one
    row per label and task shuffled, whatever the label skew.
    """
    agg = vectors.groupBy(label_col).agg(
        Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("_m"),
        F.count(F.lit(1)).alias("size"),
    )
    return agg.select(F.col(label_col).alias("label"), vector_to_array("_m").alias("center"), "size")


def topic_sizes(assigned: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, size`` - documents per topic."""
    return assigned.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("size"))


def centres_array(centres: DataFrame) -> Column:
    """Scalar subquery: all centres as ``array<struct<label, center>>`` sorted by label.

    Subqueries may not appear inside higher-order functions, so callers first
    project it into a column (``with_centres``) and score against that column.
    """
    return centres.select(
        F.array_sort(F.collect_list(F.struct(F.col("label"), F.col("center").cast("array<double>").alias("center"))))
    ).scalar()


def with_centres(docs: DataFrame, centres: DataFrame, name: str = "_centres") -> DataFrame:
    return docs.withColumn(name, centres_array(centres))


def centre_scores(vec: Column | str, centres: Column, kind: str = "cosine") -> Column:
    """``array<struct<distance, label>>`` for one vector against every centre."""
    return F.transform(
        centres, lambda c: F.struct(distance(vec, c["center"], kind).alias("distance"), c["label"].alias("label"))
    )


def assign_nearest(
    docs: DataFrame, centres: DataFrame, vec_col: str = "embedding", kind: str = "euclidean", out_col: str = "label"
) -> DataFrame:
    """Add the label of the nearest centre (ties -> smaller label) and its distance."""
    best = F.array_min(centre_scores(vec_col, F.col("_centres"), kind))
    return with_centres(docs, centres).withColumn("_best", best).withColumn(out_col, F.col("_best")["label"]).withColumn(
        "distance", F.col("_best")["distance"]
    ).drop("_best", "_centres")


def center_distances(
    docs: DataFrame, centres: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", kind: str = "euclidean"
) -> DataFrame:
    """``id, label, distance`` - distance from every document to every centre
    (the n x k transform), long form."""
    scored = with_centres(docs, centres).select(
        F.col(id_col), F.explode(centre_scores(vec_col, F.col("_centres"), kind)).alias("s")
    )
    return scored.select(id_col, F.col("s")["label"].alias("label"), F.col("s")["distance"].alias("distance"))


def nearest_k_per_doc(
    docs: DataFrame,
    centres: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    kind: str = "cosine",
) -> DataFrame:
    """``id, rank, label, distance`` - the ``k`` closest centres of every
    document, computed per row (sort of ``#centres`` entries), no window."""
    top = F.slice(F.array_sort(centre_scores(vec_col, F.col("_centres"), kind)), 1, k)
    return with_centres(docs, centres).select(F.col(id_col), F.posexplode(top).alias("pos", "s")).select(
        id_col,
        (F.col("pos") + 1).alias("rank"),
        F.col("s")["label"].alias("label"),
        F.col("s")["distance"].alias("distance"),
    )


def nearest_topics(centres: DataFrame, query: Sequence[float] | Column, n: int, kind: str = "cosine") -> DataFrame:
    """``label, distance, rank`` - the ``n`` centres closest to a query vector;
    ``n`` above the number of centres returns them all (ties by label)."""
    q = query if isinstance(query, Column) else vector_literal(query)
    scored = centres.select("label", distance(F.col("center"), q, kind).alias("distance"))
    top = scored.orderBy("distance", "label").limit(n)
    return top.select(
        "label", "distance", F.row_number().over(_rank_window()).alias("rank")
    )


def _rank_window():
    from pyspark.sql import Window

    # at most n rows (a limit), so a global window is fine
    return Window.orderBy("distance", "label")


def similar_topics(topic_vectors: DataFrame, query: Sequence[float] | Column, n: int) -> DataFrame:
    """``label, similarity, rank`` - topics by cosine similarity to the query,
    descending; the noise topic -1 is removed before taking ``n``."""
    q = query if isinstance(query, Column) else vector_literal(query)
    from pyspark.sql import Window

    scored = topic_vectors.filter(F.col("label") != -1).select(
        "label", cosine_similarity(F.col("center"), q).alias("similarity")
    )
    top = scored.orderBy(F.desc("similarity"), "label").limit(n)
    return top.select(
        "label", "similarity", F.row_number().over(Window.orderBy(F.desc("similarity"), "label")).alias("rank")
    )


def predict_within_radius(
    docs: DataFrame, centres: DataFrame, radius: float, vec_col: str = "embedding", kind: str = "euclidean"
) -> DataFrame:
    """Nearest topic when it lies within ``radius``, else -1 (noise)."""
    out = assign_nearest(docs, centres, vec_col, kind, out_col="_near")
    return out.withColumn(
        "label", F.when(F.col("distance") <= F.lit(float(radius)), F.col("_near")).otherwise(F.lit(-1))
    ).drop("_near")


# Terms scored at once; topics of near directions that are compared with them together.
TERMS = 1 << 15
TOPICS = 64


def _direction_groups(units: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of unit vectors in groups of at most ``size``, halved along their widest axis."""
    todo, out = [np.arange(len(units))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out += [rows] if len(rows) else []
            continue
        held = units[rows]
        rows = rows[np.argsort(held[:, np.ptp(held, axis=0).argmax()], kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def _units(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _largest(keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest of each row in order of place; of equal ones the first."""
    if keys.shape[1] <= n:
        return np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    least = np.partition(keys, -n, axis=1)[:, -n, None]
    kept = keys >= least
    many = np.flatnonzero(kept.sum(axis=1) > n)
    if len(many):
        equal = keys[many] == least[many]
        room = n - (keys[many] > least[many]).sum(axis=1, keepdims=True)
        kept[many] &= ~(equal & (np.cumsum(equal, axis=1) > room))
    return np.nonzero(kept)[1].reshape(len(keys), n)


def _closest(held, n: int):
    """Per task and topic the ``n`` terms of the largest weight, of rows in term order."""

    def run(batches):
        labels, centres, groups = held.value
        # weights count to ten places; of equal ones the first term is kept
        best, term = [np.empty((len(rows), 0)) for rows, _, _ in groups], [np.empty((len(rows), 0), dtype=object) for rows, _, _ in groups]
        for batch in batches:
            if not batch.num_rows or not len(labels):
                continue
            every, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            vectors = _units(vectors.flatten().to_numpy().reshape(len(every), -1))
            for at in range(0, len(every), TERMS):
                words, v = every[at : at + TERMS], vectors[at : at + TERMS]
                for i, (rows, middle, wide) in enumerate(groups):
                    # a topic is at most `wide` from the middle: its terms are among those near the middle
                    cosines, far = v @ middle, np.inf
                    if len(words) >= n:
                        far = _angles(np.partition(cosines, -n)[-n]) + 2 * wide
                    if best[i].shape[1] >= n:
                        far = min(far, float(_angles(best[i].min(axis=1) / 1e10).max()) + wide)
                    near = np.flatnonzero(cosines >= np.cos(far + 1e-6) - 1e-9) if far < 3 else np.arange(len(words))
                    if not len(near):
                        continue
                    keys = np.concatenate([best[i], np.floor((centres[rows] @ v[near].T) * 1e10 + 0.5)], axis=1)
                    top = _largest(keys, n)
                    had = best[i].shape[1]
                    found = words[near][np.maximum(top - had, 0)]
                    if had:
                        found = np.where(top < had, np.take_along_axis(term[i], np.minimum(top, had - 1), 1), found)
                    best[i], term[i] = np.take_along_axis(keys, top, 1), found
        for i, (rows, _, _) in enumerate(groups):
            if best[i].shape[1]:
                label = np.repeat(labels[rows], best[i].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(term[i].ravel(), pa.string()), pa.array(best[i].ravel() / 1e10)], ["label", "term", "weight"])

    return run


def closest_terms(words: DataFrame, topic_vectors: DataFrame, n: int) -> DataFrame:
    """``label, term, weight``: among them every topic's ``n`` terms of the largest cosine
    (to ten places; ties by term).  ``words``: ``term, v``.

    Each task passes on ``n`` terms a topic, so that no word x topic rows are made.  Topics of
    near directions form groups: the terms of a group's topics are at a bounded angle from
    its middle, and only those are scored against each of its topics."""
    topics = topic_vectors.select("label", F.col("center").cast("array<double>").alias("center")).toArrow().to_pandas()
    centres = _units(np.array(topics["center"].tolist(), dtype=np.float64).reshape(len(topics), -1 if len(topics) else 0))
    known = centres.any(axis=1)
    groups = []
    for rows in _direction_groups(centres[known], TOPICS):
        middle = _units(centres[known][rows].mean(axis=0, keepdims=True))[0]
        groups.append((np.flatnonzero(known)[rows], middle, float(_angles(centres[known][rows] @ middle).max()) if middle.any() else np.inf))
    if not known.all():
        groups.append((np.flatnonzero(~known), np.zeros(centres.shape[1]), np.inf))
    held = words.sparkSession.sparkContext.broadcast((topics["label"].to_numpy(), centres, groups))
    return words.select("term", "v").sortWithinPartitions("term").mapInArrow(_closest(held, int(n)), "label int, term string, weight double")
