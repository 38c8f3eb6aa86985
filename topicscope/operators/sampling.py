"""Scan positions and training samples (forward, backward, uniform).

The scan order is the key order.  Positions are computed without a global
single-partition window: the rows are range-partitioned and sorted by key,
tagged with their partition and in-partition index, checkpointed to the
shared checkpoint directory (which also fixes the range boundaries), and each
partition's offset is the running total of the partition counts - a table with
one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

METHODS = ("uniform", "forward", "backward")


def scan_positions(df: DataFrame, key: str = "pmid", partitions: int | None = None) -> DataFrame:
    """``pos`` (0-based position in key order) plus all columns of ``df``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n_parts, F.col(key)).sortWithinPartitions(key)
    tagged = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window here is bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local_idx = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn("pos", (F.col("_off") + local_idx).cast("long"))
    return out.select("pos", *df.columns)


def uniform_order(key: str, seed: int):
    """Seeded pseudo-random order: md5 of ``key:seed`` (stable under any
    partitioning, unlike ``rand(seed)``), ties by key."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{int(seed)}")))
    return [h, F.col(key)]


BINS = 4096
SETTLED = 10_000


def uniform_number(key: str, seed: int):
    """The first 15 hex digits of ``uniform_order`` as a number: same order, but for
    ties."""
    return F.conv(F.substring(uniform_order(key, seed)[0], 1, 15), 16, 10).cast("long")


def select_first(df: DataFrame, n: int, number: Column, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``order``, whose leading part is ``number`` (a
    long that never falls along the order).

    Distributed selection: a histogram of the numbers in ``BINS`` bins tells in which
    bin the n-th row lies, that bin is divided again, and so on until it holds at most
    ``SETTLED`` rows or one number.  Rows before the bin are taken by a filter, and only
    those of the bin are sorted.  Nothing else is sorted, shuffled or written; each round
    reads the number alone and sends at most ``BINS`` counts.  Rows without a number are
    not selected."""
    n, df = int(n), df.filter(number.isNotNull())
    if n <= 0:
        return df.limit(0)
    ends = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if ends["n"] <= n:
        return df
    lo, hi, before = ends["lo"], ends["hi"], 0
    while True:
        width = -(-(hi - lo + 1) // BINS)
        at = F.call_function("div", number - F.lit(lo), F.lit(width).cast("long"))
        counts = sorted(map(tuple, df.filter(number.between(F.lit(lo), F.lit(hi))).groupBy(at.alias("b")).count().collect()))
        for b, held in counts:
            if before + held >= n:
                break
            before += held
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        if held <= SETTLED or lo == hi:
            break
    last = df.filter(number.between(F.lit(lo), F.lit(hi))).orderBy(*order).limit(n - before)
    return df.filter(number < F.lit(lo)).unionByName(last)


def first_in_order(df: DataFrame, n: int, key: str, method: str, seed: int = 0) -> DataFrame:
    """The keys of the first ``n`` rows in scan order (``forward``), from its end
    (``backward``) or in the seeded order (``uniform``)."""
    keys = df.select(key)
    if method == "uniform":
        return select_first(keys, n, uniform_number(key, seed), uniform_order(key, seed))
    number = F.col(key).cast("long")
    return select_first(keys, n, number, [F.col(key)]) if method == "forward" else select_first(keys, n, -number, [F.desc(key)])


def sample(
    df: DataFrame,
    n: int,
    method: str = "uniform",
    key: str = "pmid",
    seed: int | None = 0,
    check: bool = True,
) -> DataFrame:
    """``n`` rows in scan order with their scan position ``pos``.

    * ``forward``  - the first ``n`` of the scan;
    * ``backward`` - the last ``n`` (all rows when ``n`` exceeds the total);
    * ``uniform``  - ``n`` rows without replacement in a seeded order; asking for
      more rows than exist is an error.
    """
    if method not in METHODS:
        raise ValueError(f"Invalid method: {method}")
    n = int(n)
    if n < 0:
        raise ValueError("n must be >= 0")
    if method == "uniform" and check:
        total = df.count()
        if n > total:
            raise ValueError(f"cannot sample {n} rows without replacement from {total}")
    cols = df.columns
    if method in ("forward", "backward"):
        number = F.col(key).cast("long")
        if method == "forward":
            return scan_positions(select_first(df, n, number, [F.col(key)]), key)
        # the positions of the last rows follow from their number
        total = df.count()
        rows = scan_positions(select_first(df, n, -number, [F.desc(key)]), key)
        return rows.withColumn("pos", F.col("pos") + F.lit(max(0, total - n)))
    # uniform; positions in the whole scan need all keys in order
    chosen = first_in_order(df, n, key, "uniform", seed if seed is not None else 0)
    return scan_positions(df, key).join(chosen, key, "left_semi").orderBy("pos")
