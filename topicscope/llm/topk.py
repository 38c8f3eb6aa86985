"""Exact top-k search by distributed histogram selection.

Vectors become integers ``floor(scale * x)``; the score of a query and a
candidate is their inner product.  All scores are computed, but none is
shuffled: a grid of bounded blocks of queries and candidates scores itself, and

1. every block sends per query a histogram of its scores, from the top until k
   scores are covered; the sums locate the bin that holds the k-th value;
2. that bin is divided again and the histograms repeated, until bins are single
   integers and the k-th value of each query is known;
3. every block sends the scores at or above it (ties: the k least ids, which no
   other tie of that block can beat), and the final ranking is by score
   descending, then id.

Vectors that are null, empty or hold a null or non-finite component take no
part, nor do rows without an id; vectors of another length than the query's are
no candidates of it.  A query never returns its own row, but repeated rows with
its id are its own as well.  Equal rows of one query id are one query; different
vectors of one query id pool their scores, and its k best are taken from the pool.  Fewer than k candidates are all returned.
Components so large that a score could pass 62 bits raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _bytes as B

SCALE, K, EVERY = 256, 5, 50
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
BINS = 1024


def quantised(df: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, v): the integer vector as packed little-endian int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if i is None or not x or any(y is None for y in x):
                    continue
                y = np.floor(np.asarray(x, np.float64) * scale)
                if np.isfinite(y).all():
                    y = np.clip(y, -(2.0**62), 2.0**62)
                    ids.append(i)
                    dims.append(len(x))
                    out.append(y.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])

    source = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return source.mapInArrow(run, "id long, dim int, v binary")


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), -1)


def _scores(queries: pd.DataFrame, candidates: pd.DataFrame) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    q, c = _matrix(queries["v"]), _matrix(candidates["v"])
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _histograms(k: int):
    """Per query: its bins of ``lo .. lo + BINS * width`` from the top until k
    scores are covered."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "bin": [], "n": []}
        if len(queries) and len(candidates):
            scores, ids = _scores(queries, candidates), candidates["id"].to_numpy()
            for row, qid, lo, width, above in zip(scores, queries["id"], queries["lo"], queries["width"], queries["above"], strict=True):
                mine = row[ids != qid]
                bins = (mine - lo) // width
                counts = np.bincount(bins[(bins >= 0) & (bins < BINS)], minlength=BINS)
                from_top = np.cumsum(counts[::-1])[::-1]
                keep = np.flatnonzero((counts > 0) & (from_top - counts < k - above))
                out["query_id"].append(np.full(len(keep), qid))
                out["bin"].append(keep)
                out["n"].append(counts[keep])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return run


def _survivors(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("id", kind="stable")
            scores, ids = _scores(queries, candidates), candidates["id"].to_numpy()
            for row, qid, kth in zip(scores, queries["id"], queries["kth"], strict=True):
                at = np.flatnonzero((row >= kth) & (ids != qid))
                at = at[np.argsort(-row[at], kind="stable")][:k]
                out["query_id"].append(np.full(len(at), qid))
                out["vec_id"].append(ids[at])
                out["score"].append(row[at])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return run


def exact_top_k(df: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query
    (the rows whose id is divisible by ``every``)."""
    vectors = B.stage(quantised(df, scale, vec_id, vector), "topk-vectors")
    wanted = F.pmod("id", F.lit(every)) == 0
    # repeated query rows with equal vectors are one query
    asked = B.stage(vectors.filter(wanted).dropDuplicates(["id", "v"]), "topk-asked")
    n, m, most = vectors.agg(F.count(F.lit(1)), F.count(F.when(wanted, 1)), F.max(F.length("v"))).first()
    # blocks: hashed on the id, so no block depends on how ids are spread
    down, across = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-(m or 0) // QUERY_BLOCK))
    lane = lambda salt, size: F.pmod(F.xxhash64("id", F.monotonically_increasing_id() if salt < 0 else F.lit(salt)), F.lit(size)).cast("int")
    candidates = vectors.withColumn("r", lane(-1, down)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    grid = candidates.groupBy("dim", "r", "c")

    def spread(queries: DataFrame):
        return queries.withColumn("c", lane(2, across)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).groupBy("dim", "r", "c")

    peak = vectors.mapInArrow(_peaks, "p double").agg(F.max("p")).first()[0] or 0.0
    reach = int(peak) * int(peak) * ((most or 0) // 8) + 1
    if reach >= 1 << 62:
        raise ValueError(f"scores of up to {reach} do not fit 62 bits: scale the vectors down")
    width = 1
    while width * BINS < 2 * reach + 1:
        width *= BINS
    # one state per query id: rows of one id with different vectors pool their scores
    state = B.stage(asked.select("id").distinct().select("id", F.lit(-reach).cast("long").alias("lo"), F.lit(width).cast("long").alias("width"), F.lit(0).cast("long").alias("above")), "topk-state")
    while True:
        bins = spread(asked.join(state, "id")).cogroup(grid).applyInPandas(_histograms(k), "query_id long, bin long, n long")
        total = bins.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # from the top: the bin in which the k-th score falls, or the last one there is
        down_to = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        total = total.join(state.select(F.col("id").alias("query_id"), F.col("above").alias("was")), "query_id")
        over = total.withColumn("over", F.sum("n").over(down_to) - F.col("n") + F.col("was")).filter(F.col("over") < k)
        found = over.groupBy("query_id").agg(F.min(F.struct("bin", "over")).alias("at"))
        state = state.join(found, state.id == found.query_id)
        state = state.select("id", (F.col("lo") + F.col("at.bin") * F.col("width")).alias("lo"), F.col("width"), F.col("at.over").alias("above"))
        state = B.stage(state, "topk-state")
        if width == 1:
            break
        width //= BINS
        state = state.withColumn("width", F.lit(width).cast("long"))
    best = spread(asked.join(state.withColumnRenamed("lo", "kth"), "id")).cogroup(grid).applyInPandas(_survivors(k), "query_id long, vec_id long, score long")
    # at most k rows of a query come from each block of candidates
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        top = max((float(np.abs(np.frombuffer(v.as_buffer(), np.int64)).max()) for v in batch.column("v")), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["p"])

