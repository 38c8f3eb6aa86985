"""Cluster quality scores as Spark jobs: Calinski-Harabasz, Davies-Bouldin and
the silhouette.

Each score makes one pass over the points to build per-cluster statistics
(count, vector sum, sum of squared norms: ``k`` rows, partially aggregated),
then finishes on those ``k`` rows inside the same plan.  The Davies-Bouldin
scatter and the silhouette need a second pass that looks up the point's own
and the other clusters' statistics from a scalar subquery (a map of ``k``
entries), so no point-point or point-centre pair table is ever built.

The silhouette uses squared Euclidean distance, which decomposes into
per-cluster sums and is therefore linear in the number of points (the same
definition as Spark ML's ``ClusteringEvaluator``).  Plain Euclidean distance
does not decompose and needs every pair of points; that quadratic variant is
not offered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, dot, euclidean, squared_euclidean, squared_norm


def cluster_stats(points: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``label, n, s array<double>, q`` - count, vector sum, sum of squared norms."""
    v = as_double(vec_col)
    agg = points.groupBy(F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        Summarizer.sum(array_to_vector(v)).alias("_s"),
        F.sum(squared_norm(v)).alias("q"),
    )
    return agg.select("label", "n", vector_to_array("_s").alias("s"), "q")


def _vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _vec_div(a: Column, d: Column) -> Column:
    return F.transform(a, lambda x: x / d)


def calinski_harabasz(
    points: DataFrame, label_col: str = "label", vec_col: str = "embedding", stats: DataFrame | None = None
) -> DataFrame:
    """One row ``calinski_harabasz``: between/within dispersion ratio; 1.0 when
    the within dispersion is zero."""
    stats = stats if stats is not None else cluster_stats(points, label_col, vec_col)
    one = stats.agg(F.collect_list(F.struct("n", "s", "q")).alias("C"))
    zero = F.array_repeat(F.lit(0.0), F.size(F.col("C")[0]["s"]))
    one = (
        one.withColumn("N", F.aggregate("C", F.lit(0.0), lambda a, c: a + c["n"]))
        .withColumn("k", F.size("C").cast("double"))
        .withColumn("mu", _vec_div(F.aggregate("C", zero, lambda a, c: _vec_add(a, c["s"])), F.col("N")))
        .withColumn(
            "trb",
            F.aggregate(
                "C", F.lit(0.0), lambda a, c: a + c["n"] * squared_euclidean(_vec_div(c["s"], c["n"]), F.col("mu"))
            ),
        )
        .withColumn(
            "trw", F.aggregate("C", F.lit(0.0), lambda a, c: a + c["q"] - squared_norm(c["s"]) / c["n"])
        )
    )
    # one cluster has no score (null)
    score = F.when(F.col("trw") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("trb") * (F.col("N") - F.col("k")), F.col("trw") * (F.col("k") - F.lit(1.0)))
    )
    return one.select(score.alias("calinski_harabasz"))


def _centroid_map(stats: DataFrame) -> Column:
    return stats.select(
        F.map_from_entries(F.collect_list(F.struct("label", _vec_div(F.col("s"), F.col("n")))))
    ).scalar()


def davies_bouldin(
    points: DataFrame, label_col: str = "label", vec_col: str = "embedding", stats: DataFrame | None = None
) -> DataFrame:
    """One row ``davies_bouldin``: mean over clusters of the worst
    ``(S_i + S_j) / d(c_i, c_j)``; ``S`` = mean distance to the own centroid.
    Coinciding centroids contribute 0 (not infinity)."""
    stats = stats if stats is not None else cluster_stats(points, label_col, vec_col)
    cmap = _centroid_map(stats)
    scatter = (
        points.select(F.col(label_col).alias("label"), as_double(vec_col).alias("v"))
        .withColumn("_own", F.element_at(cmap, F.col("label")))
        .withColumn("d", euclidean("v", F.col("_own")))
        .groupBy("label")
        .agg(F.avg("d").alias("S"))
    )
    per = scatter.select("label", "S", F.element_at(cmap, F.col("label")).alias("c"))
    one = per.agg(F.collect_list(F.struct("label", "S", "c")).alias("C"))

    def worst(ci):
        ratios = F.transform(
            F.filter(F.col("C"), lambda cj: cj["label"] != ci["label"]),
            lambda cj: F.coalesce(F.try_divide(ci["S"] + cj["S"], euclidean(ci["c"], cj["c"])), F.lit(0.0)),
        )
        return F.coalesce(F.array_max(ratios), F.lit(0.0))

    scores = F.transform("C", worst)
    all_scatter_zero = F.aggregate("C", F.lit(0.0), lambda a, c: a + c["S"]) == 0
    mean_score = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return one.select(F.when(all_scatter_zero, F.lit(0.0)).otherwise(mean_score).alias("davies_bouldin"))


def silhouette(
    points: DataFrame, label_col: str = "label", vec_col: str = "embedding", stats: DataFrame | None = None
) -> DataFrame:
    """One row ``silhouette``: mean silhouette with squared Euclidean distance.

    Mean squared distance from ``x`` to cluster ``c`` is
    ``|x|^2 + q_c / n_c - 2 x.s_c / n_c``; the own cluster is rescaled by
    ``n / (n - 1)`` to leave ``x`` out; singletons score 0.
    """
    stats = stats if stats is not None else cluster_stats(points, label_col, vec_col)
    carr = stats.select(F.collect_list(F.struct("label", "n", "s", "q"))).scalar()
    p = (
        points.select(F.col(label_col).alias("label"), as_double(vec_col).alias("v"))
        .withColumn("x2", squared_norm("v"))
        .withColumn("_stats", carr)
    )
    carr = F.col("_stats")

    def mean_sq(c):
        return F.col("x2") + c["q"] / c["n"] - F.lit(2.0) * dot(F.col("v"), c["s"]) / c["n"]

    own = F.filter(carr, lambda c: c["label"] == F.col("label"))[0]
    others = F.transform(F.filter(carr, lambda c: c["label"] != F.col("label")), mean_sq)
    p = p.withColumn("own_n", own["n"]).withColumn("a", F.try_divide(mean_sq(own) * own["n"], own["n"] - F.lit(1.0)))
    p = p.withColumn("b", F.array_min(others))
    s = (
        F.when(F.col("own_n") <= 1, F.lit(0.0))
        .when(F.col("a") < F.col("b"), F.lit(1.0) - F.try_divide("a", "b"))
        .when(F.col("a") > F.col("b"), F.try_divide("b", "a") - F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return p.agg(F.avg(s).alias("silhouette"))


SCORES: dict[str, Callable[..., DataFrame]] = {
    "silhouette": silhouette,
    "calinski_harabasz": calinski_harabasz,
    "davies_bouldin": davies_bouldin,
}


def evaluate_clusters(
    points: DataFrame,
    label_col: str = "label",
    vec_col: str = "embedding",
    scores: dict[str, Callable[[DataFrame, str, str], DataFrame]] | None = None,
) -> DataFrame:
    """One row with one column per score (default: all three).  Custom scores
    are callables ``(points, label_col, vec_col) -> one-row DataFrame``."""
    chosen = dict(SCORES) if scores is None else dict(scores)
    if not chosen:
        raise ValueError("no scores requested")
    # the per-cluster statistics (k rows) are computed once and shared by the
    # built-in scores
    stats = cluster_stats(points, label_col, vec_col).checkpoint(eager=True)
    cols = []
    for name, fn in chosen.items():
        r = fn(points, label_col, vec_col, stats=stats) if fn in SCORES.values() else fn(points, label_col, vec_col)
        cols.append(r.select(F.col(r.columns[0])).scalar().alias(name))
    # each score is a one-row scalar subquery of the same one-row result
    return points.sparkSession.range(1).select(*cols)
