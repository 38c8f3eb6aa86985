"""Truncated (uncentred) SVD of a sparse document-term matrix held in long
form ``(doc_id, idx, w)``.

Randomized range finder with power iterations (Halko, Martinsson & Tropp,
"Finding structure with randomness", 2011), orthonormalised with Cholesky-QR
so that every tall matrix stays distributed:

* ``X @ Z``  (n x l): join the non-zeros with the rows of a d x l matrix on
  ``idx`` and sum per document (one code-generated ``sum`` per component,
  partially aggregated);
* ``X.T @ Y`` (d x l): join the non-zeros with the per-document rows on
  ``doc_id`` and sum per term;
* ``A.T @ A`` (l x l) for any tall ``A``: one vector-sum aggregate.

While the d x l matrix (l = components + oversampling) is under ``DENSE_BYTES``, the
non-zeros are put together once, a row per document, and a pass ``X.T @ (X @ Z)`` is one
map over these rows with ``Z`` broadcast: a document's row of ``X @ Z`` is used where it
is made, every task adds up its own d x l sum, and only the touched rows of these sums
are shuffled, so a pass moves none of the non-zeros.  Beyond that bound the joins above
are used, and the d x l and d x k matrices are DataFrames of ``(idx, v array<double>)``,
checkpointed between passes.  The small eigen-decompositions run in NumPy on the driver.
The random start matrix is generated on the executors from a hash of
``(idx, column, seed)``, so it does not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Largest d x l matrix (in bytes) used as a broadcast join side.
BROADCAST_MATRIX_BYTES = 256 * 1024 * 1024
# Largest d x l matrix (in bytes) held by the driver and by every task of a pass.
DENSE_BYTES = 64 * 1024 * 1024
# Packed rows multiplied at once.
ROWS = 2000


def matrix_frame(spark: SparkSession, m: np.ndarray, key: str = "idx") -> DataFrame:
    """Rows of a small dense matrix as ``(idx, v array<double>)``."""
    rows = [(int(i), [float(x) for x in m[i]]) for i in range(m.shape[0])]
    return spark.createDataFrame(rows, f"{key} int, v array<double>")


def gaussian_frame(spark: SparkSession, d: int, width: int, seed: int) -> DataFrame:
    """``(idx, v)``: a d x width standard normal matrix, generated per row from
    hashes (Box-Muller), identical under any partitioning."""
    two31 = float(2**31)

    def unif(j: Column, salt: int) -> Column:
        h = F.pmod(F.xxhash64(F.col("id"), j, F.lit(int(seed)), F.lit(salt)), F.lit(2**31))
        return (h.cast("double") + F.lit(1.0)) / F.lit(two31 + 1.0)

    v = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.sqrt(F.lit(-2.0) * F.log(unif(j, 1))) * F.cos(F.lit(2 * math.pi) * unif(j, 2)),
    )
    return spark.range(d).select(F.col("id").cast("int").alias("idx"), v.alias("v"))


def _side(df: DataFrame, n_rows: int | None, width: int) -> DataFrame:
    if n_rows is not None and n_rows * width * 8 <= BROADCAST_MATRIX_BYTES:
        return F.broadcast(df)
    return df


def times_matrix(x: DataFrame, m, spark: SparkSession, n_rows: int | None = None, width: int | None = None) -> DataFrame:
    """``X @ M`` -> ``(doc_id, y array<double>)`` for ``M`` given as a NumPy
    array or an ``(idx, v)`` DataFrame.  Documents with no non-zero entry do not
    appear (their row is all zeros)."""
    if isinstance(m, np.ndarray):
        n_rows, width = m.shape
        m = matrix_frame(spark, m)
    mf = _side(m.select("idx", "v"), n_rows, width or 1)
    j = x.join(mf, "idx")
    return _sum_rows(j, "doc_id", "v", width, "y")


def _sum_rows(j: DataFrame, key: str, vec: str, width: int | None, out: str) -> DataFrame:
    """``sum(w * vec)`` per ``key``.  With a known width: one code-generated
    ``sum`` per component (plain doubles in the aggregation buffer); otherwise
    a vector-sum aggregate."""
    if width:
        agg = j.groupBy(key).agg(*[F.sum(F.col(vec)[i] * F.col("w")).alias(f"_s{i}") for i in range(width)])
        return agg.select(key, F.array(*[F.col(f"_s{i}") for i in range(width)]).alias(out))
    scaled = F.transform(vec, lambda e: e * F.col("w"))
    agg = j.groupBy(key).agg(Summarizer.sum(array_to_vector(scaled)).alias("_v"))
    return agg.select(key, vector_to_array("_v").alias(out))


def transpose_times(x: DataFrame, y: DataFrame, width: int | None = None) -> DataFrame:
    """``X.T @ Y`` -> ``(idx, v array<double>)`` (one row per term)."""
    return _sum_rows(x.join(y, "doc_id"), "idx", "y", width, "v")


def gram(a: DataFrame, col: str, width: int) -> np.ndarray:
    """``A.T @ A`` (width x width) of the rows of ``a[col]``.

    Each task multiplies its rows as one NumPy block (Arrow batches) and emits
    one partial width x width sum; the partial sums are added by a vector-sum
    aggregate, so the result costs one small row per task.
    """

    def partial(batches):
        acc = np.zeros((width, width))
        for pdf in batches:
            vals = pdf[col].values
            if len(vals):
                block = np.vstack(vals).astype(np.float64)
                acc += block.T @ block
        yield pd.DataFrame({"g": [acc.ravel()]})

    parts = a.select(col).mapInPandas(partial, "g array<double>")
    row = parts.agg(Summarizer.sum(array_to_vector("g")).alias("g")).select(vector_to_array("g").alias("g")).first()
    if row is None or row["g"] is None:
        return np.zeros((width, width))
    return np.asarray(row["g"]).reshape(width, width)


def project(a: DataFrame, col: str, m: np.ndarray, out: str) -> DataFrame:
    """Each row vector times a small constant matrix ``m`` (width x r), as a
    NumPy matrix product per Arrow batch."""
    mat = np.asarray(m, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        prod = np.vstack(v.values).astype(np.float64) @ mat
        return pd.Series(list(prod))

    return a.withColumn(out, times(F.col(col)))


def projected(col: str, components: DataFrame, d: int, k: int) -> Column:
    """The rows of ``col`` (arrays) times ``components`` (``idx, v``; d x k).  Rows of
    another length are cut or filled with zeros, nulls and NaN are 0."""
    mat = _dense(components, d, k)

    @F.pandas_udf("array<double>")
    def times(rows: pd.Series) -> pd.Series:
        block = np.zeros((len(rows), d))
        for i, v in enumerate(rows):
            if v is not None and len(v):
                v = np.asarray(v, dtype=np.float64)[:d]
                block[i, : len(v)] = v
        block[np.isnan(block)] = 0.0
        out = block @ mat
        out[np.isnan(out)] = 0.0  # infinite numbers times zeros
        return pd.Series(list(out))

    return times(F.col(col))


def _inv_sqrt(g: np.ndarray) -> np.ndarray:
    """``W`` with ``W.T G W = I`` on the numerically non-zero spectrum."""
    evals, evecs = np.linalg.eigh(g)
    keep = evals > max(float(evals.max()), 0.0) * 1e-12
    return evecs[:, keep] / np.sqrt(evals[keep])


def packed_rows(x: DataFrame) -> DataFrame:
    """``row array<struct<idx, w>>``: the non-zeros of every document."""
    rows = x.filter("idx is not null and w is not null").groupBy("doc_id").agg(F.collect_list(F.struct("idx", "w")).alias("row"))
    return written(rows.select("row"), "packed-rows")


def _dense(rows: DataFrame, d: int, width: int) -> np.ndarray:
    """``(idx, v)`` as a d x width matrix; rows that are not there are zeros."""
    t = rows.select("idx", "v").toArrow()
    out = np.zeros((d, width))
    if t.num_rows:
        v = t.column("v").combine_chunks()
        out[t.column("idx").to_numpy()] = v.flatten().to_numpy().reshape(-1, width)
    return out


def _normal_pass(packed: DataFrame, z: np.ndarray) -> np.ndarray:
    """``X.T @ (X @ Z)`` in one map over the packed rows."""
    d, width = z.shape
    sc = packed.sparkSession.sparkContext
    held = sc.broadcast(np.ascontiguousarray(z.T))

    def run(batches):
        zt = held.value
        acc = np.zeros(zt.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                lists = batch.column(0).slice(at, ROWS)
                counts = pc.list_value_length(lists).to_numpy()
                flat = lists.flatten()
                idx, w = flat.field("idx").to_numpy(), flat.field("w").to_numpy()
                row = np.repeat(np.arange(len(counts)), counts)
                for j in range(len(zt)):
                    y = np.bincount(row, zt[j][idx] * w, len(counts))
                    acc[j] += np.bincount(idx, y[row] * w, zt.shape[1])
        touched = np.flatnonzero(acc.any(axis=0))
        for at in range(0, len(touched), ROWS * 10):
            i = touched[at : at + ROWS * 10]
            v = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * len(zt), acc[:, i].T.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), v], ["idx", "v"])

    # every running task holds a sum of its own: no more tasks than run at a time
    parts = packed.coalesce(sc.defaultParallelism).mapInArrow(run, "idx int, v array<double>")
    out = _dense(_sum_rows(parts.withColumn("w", F.lit(1.0)), "idx", "v", width, "v"), d, width)
    held.destroy()
    return out


def top_vectors(normal: Callable[[np.ndarray], np.ndarray], start: Callable[[], np.ndarray], k: int, n_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """The top-``k`` right singular vectors (d x k) and singular values of the matrix X
    of which ``normal`` gives ``X.T @ (X @ Z)``, from the matrix that ``start`` makes (no caller
    holds it: two matrices of this size are held at a time)."""
    z = start()
    for _ in range(n_iter):
        c = normal(z)
        z = c @ _inv_sqrt(c.T @ c)
    c = normal(z)
    g = z.T @ c  # (X Z).T (X Z)
    bt = c @ _inv_sqrt((g + g.T) / 2)
    lam, u = np.linalg.eigh(bt.T @ bt)
    order = np.argsort(lam)[::-1][:k]
    s = np.sqrt(np.clip(lam[order], 0.0, None))
    keep = s > (s[0] if len(s) else 0.0) * 1e-12
    v, s = bt @ (u[:, order][:, keep] / s[keep]), s[keep]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return np.pad(v, ((0, 0), (0, k - len(s)))), np.pad(s, (0, k - len(s)))


def _dense_svd(x: DataFrame, d: int, k: int, width: int, n_iter: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """``randomized_svd`` with the d x width matrix on the driver."""
    spark = x.sparkSession
    packed = packed_rows(x)
    v, s = top_vectors(lambda z: _normal_pass(packed, z), lambda: _dense(gaussian_frame(spark, d, width, seed), d, width), k, n_iter)
    lists = pa.ListArray.from_arrays(np.arange(d + 1, dtype=np.int32) * k, v.ravel())
    frame = spark.createDataFrame(pa.table({"idx": pa.array(np.arange(d), pa.int32()), "v": lists}))
    return frame.checkpoint(eager=True), s


def randomized_svd(
    x: DataFrame,
    d: int,
    k: int,
    oversample: int = 10,
    n_iter: int = 5,
    seed: int = 0,
) -> tuple[DataFrame, np.ndarray]:
    """Top-``k`` right singular vectors ``V`` as a DataFrame ``(idx, v)`` (d rows,
    ``v`` of length k) and the singular values, of ``X`` given as long form
    ``(doc_id, idx, w)`` with ``0 <= idx < d``.

    Signs are fixed so that the largest-magnitude entry of every singular
    vector is positive.
    """
    spark = x.sparkSession
    k = int(min(k, d))
    width = int(min(d, k + oversample))
    x = x.select("doc_id", F.col("idx").cast("int").alias("idx"), F.col("w").cast("double").alias("w"))
    if d * width * 8 <= DENSE_BYTES:
        return _dense_svd(x, d, k, width, n_iter, seed)
    z = gaussian_frame(spark, d, width, seed)
    for _ in range(n_iter):
        c = transpose_times(x, times_matrix(x, z, spark, d, width), width).checkpoint(eager=True)
        w = _inv_sqrt(gram(c, "v", width))
        width = w.shape[1]
        z = project(c, "v", w, "_z").select("idx", F.col("_z").alias("v")).checkpoint(eager=True)
    y = times_matrix(x, z, spark, d, width).checkpoint(eager=True)
    wy = _inv_sqrt(gram(y, "y", width))  # Q = Y wy has orthonormal columns
    c = transpose_times(x, y, width)
    bt = project(c, "v", wy, "_b").select("idx", F.col("_b").alias("b")).checkpoint(eager=True)  # B^T = X^T Q
    r = wy.shape[1]
    lam, u = np.linalg.eigh(gram(bt, "b", r))  # B B^T = U diag(s^2) U^T
    order = np.argsort(lam)[::-1][:k]
    s = np.sqrt(np.clip(lam[order], 0.0, None))
    keep = s > (s[0] if len(s) else 0.0) * 1e-12
    u_k = u[:, order][:, keep] / s[keep]
    v = project(bt, "b", u_k, "_v").select("idx", F.col("_v").alias("v"))
    kk = u_k.shape[1]
    # sign of the largest-magnitude entry of each column (k values to the driver)
    ext = v.agg(*[F.max_by(F.col("v")[j], F.abs(F.col("v")[j])).alias(f"m{j}") for j in range(kk)]).first()
    signs = np.array([1.0 if (ext[f"m{j}"] or 0.0) >= 0 else -1.0 for j in range(kk)])
    if kk < k:
        signs = np.concatenate([signs, np.ones(k - kk)])
        s = np.concatenate([s[keep], np.zeros(k - kk)])
    else:
        s = s[keep]
    lit_signs = F.array(*[F.lit(float(x)) for x in signs])
    pad = F.array_repeat(F.lit(0.0), k - kk)
    v = v.select("idx", F.zip_with(F.concat("v", pad), lit_signs, lambda a, b: a * b).alias("v"))
    return v.checkpoint(eager=True), s
