"""Bulk labelling of the corpus: every article without a prediction gets its
topic label, its reconstructed date and its completion date.

``forward`` takes articles in identifier order, ``uniform`` in a seeded
pseudo-random order (so that a capped or timed run is an unbiased sample);
``max_new`` caps the number of new predictions.  The prediction table is a store of
deltas partitioned by label (``sources.delta_store``); articles already in it are
skipped, or with ``overwrite`` labelled again and upserted: rows of other articles
always stay.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import combine_text
from ..operators.sampling import first_in_order, scan_positions, uniform_order
from ..operators.store import unpredicted
from ..operators.trends import completion_offset, with_reconstructed_date
from ..session import shared_dir
from ..sources.delta_store import PredictionStore

ORDER_METHODS = ("forward", "uniform")
BATCH_SIZE = 10_000


def _order(method: str, seed: int):
    if method not in ORDER_METHODS:
        raise ValueError(f"Invalid method: {method}")
    return F.col("pmid") if method == "forward" else uniform_order("pmid", seed)[0]


def labelled(model, articles: DataFrame, offset: DataFrame | None = None, combine_kwargs: dict | None = None) -> DataFrame:
    """``pmid, date, date_completed, label`` of all of ``articles``."""
    dated = with_reconstructed_date(articles, offset).dropDuplicates(["pmid"])
    kw = combine_kwargs if combine_kwargs is not None else getattr(model, "combine_kwargs", None) or {}
    text = combine_text("title", "abstract", "keywords_major", "keywords_minor", **kw).alias("text")
    labels = model.predict(dated.select(F.col("pmid").alias("doc_id"), text))
    return dated.select("pmid", "date", "date_completed").join(
        labels.select(F.col("doc_id").alias("pmid"), F.col("label").cast("int").alias("label")), "pmid"
    )


def new_predictions(
    model,
    articles: DataFrame,
    existing: DataFrame | None = None,
    max_new: int | None = None,
    method: str = "uniform",
    seed: int = 0,
    combine_kwargs: dict | None = None,
    offset: DataFrame | None = None,
) -> DataFrame:
    """``pmid, date, date_completed, label`` for articles not yet predicted.

    ``articles`` is the flat article view (``pmid, title, abstract,
    keywords_major, keywords_minor, article_date, date_completed``).  The
    completion offset for date reconstruction is that of ``offset``
    (``completion_offset`` of the whole corpus) or computed over ``articles``.
    A cap is cut on identifiers alone, by distributed selection; the texts of
    the chosen rows are joined afterwards.
    """
    _order(method, seed)
    if max_new is not None and max_new <= 0:
        raise ValueError("max_new must be positive")
    offset = completion_offset(articles) if offset is None else offset
    todo = articles if existing is None else unpredicted(articles, existing.select("pmid"), "pmid")
    if max_new is not None:
        todo = todo.join(first_in_order(todo.select("pmid").distinct(), max_new, "pmid", method, seed), "pmid", "left_semi")
    return labelled(model, todo, offset, combine_kwargs)


def merged_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same articles."""
    return old.join(new.select("pmid"), "pmid", "left_anti").unionByName(new)


def _store(spark: SparkSession, table: str | PredictionStore) -> PredictionStore:
    return table if isinstance(table, PredictionStore) else PredictionStore(spark, table)


def write_predictions(spark: SparkSession, new: DataFrame, table: str | PredictionStore, upsert: bool = False, batch: tuple[str, int] | None = None) -> int:
    """Put ``new`` into the prediction store ``table``; with ``upsert`` rows of the same
    articles are replaced.  Costs the rows of ``new``, not those of the table.  Returns
    the rows written (0 for a ``batch`` that was committed before)."""
    store = _store(spark, table)
    rows = new.select("pmid", "date", "date_completed", "label")
    return store.upsert(rows, batch) if upsert else store.append(rows, batch)


def _batches(spark: SparkSession, articles: DataFrame, placed: DataFrame, size: int) -> str:
    """The articles of ``placed(pmid, pos)`` written once, a folder a batch, so that a
    batch reads its own rows only."""
    path = f"{shared_dir(spark, 'tables')}/batches-{uuid.uuid4().hex[:12]}"
    at = placed.select("pmid", F.floor(F.col("pos") / F.lit(size)).cast("long").alias("_batch"))
    rows = articles.join(at, "pmid").repartition(F.col("_batch"), F.pmod(F.xxhash64("pmid"), F.lit(4)))
    rows.write.partitionBy("_batch").parquet(path)
    return path


def precompute_predictions(
    spark: SparkSession,
    model,
    articles: DataFrame,
    table: str | PredictionStore,
    max_new: int | None = None,
    method: str = "uniform",
    overwrite: bool = False,
    seed: int = 0,
    batch_size: int | None = None,
    timeout: float | None = None,
    combine_kwargs: dict | None = None,
    stop: Callable[[], bool] | None = None,
) -> int:
    """Label articles into ``table``; returns the number labelled.

    The identifiers to do are chosen and numbered once and cut into batches of
    ``batch_size`` (one batch without it; ``BATCH_SIZE`` if a ``timeout`` or ``stop`` is
    given); ``timeout`` seconds and ``stop()`` are checked between batches.  Every
    batch is one commit: a run that dies keeps the batches before it.  For continuous
    runs use the labelling stream (``streaming.labelling``).
    """
    order = _order(method, seed)
    for name, value in (("max_new", max_new), ("batch_size", batch_size), ("timeout", timeout)):
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")
    start = time.monotonic()
    offset = completion_offset(articles).checkpoint(eager=True)
    ids = articles.select("pmid").distinct()
    store = _store(spark, table)
    if not overwrite and store.exists():
        ids = unpredicted(ids, store.read().select("pmid"), "pmid")
    if (timeout is not None or stop is not None) and batch_size is None:
        batch_size = BATCH_SIZE
    if max_new is None and batch_size is None:
        todo = articles.join(ids.checkpoint(eager=True), "pmid", "left_semi")
        return write_predictions(spark, labelled(model, todo, offset, combine_kwargs), store, overwrite)
    if max_new is not None:
        ids = first_in_order(ids.checkpoint(eager=True), max_new, "pmid", method, seed)
    ranked = ids.select("pmid", F.struct(order.alias("o"), F.col("pmid").alias("k")).alias("_order"))
    placed = scan_positions(ranked, "_order").select("pmid", "pos").checkpoint(eager=True)
    n, total = placed.count(), 0
    size = batch_size or max(1, n)
    if not n:
        return 0
    path = _batches(spark, articles, placed, size)
    for i in range(-(-n // size)):
        todo = spark.read.schema(articles.schema).parquet(f"{path}/_batch={i}")
        total += write_predictions(spark, labelled(model, todo, offset, combine_kwargs), store, overwrite)
        if (timeout is not None and time.monotonic() - start >= timeout) or (stop is not None and stop()):
            break
    return total
