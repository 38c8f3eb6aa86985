"""Plan-shape helpers shared by the operators: size-checked broadcast and a
skew-safe top-k per group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# A broadcast hint is only placed on a side whose row count is bounded by a
# parameter the caller knows (top-n dates, k centres, chosen labels).  Anything
# else is left to AQE, which broadcasts at run time only when the measured size
# is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
MAX_HINTED_BROADCAST_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Broadcast ``df`` if its proven row bound is small, else leave it to AQE."""
    if row_bound is not None and row_bound <= MAX_HINTED_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    Rounds that join their own results use this in place of ``checkpoint()``: a
    checkpointed plan keeps its estimated size, and the product of a join's sizes
    taken round by round grows without bound; a file has its true size.
    """
    path = f"{shared_dir(df.sparkSession, 'tables')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    k: int,
    tiebreak_col: str,
    salt_buckets: int = 32,
    rank_col: str = "rank",
) -> DataFrame:
    """Exact top-``k`` rows of every group, safe when one group is huge.

    A plain ``row_number() over (partition by g ...)`` sends a whole group to a
    single task.  Here each group is first split into ``salt_buckets`` pieces by
    a hash of ``tiebreak_col``; the top ``k`` of each piece is kept, and the final
    ranking runs over at most ``k * salt_buckets`` rows per group.  The global
    top ``k`` is always inside the union of the per-piece top ``k``, so the result
    is exact.  ``order`` must be a total order (end it with the tiebreak).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(tiebreak_col)), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
