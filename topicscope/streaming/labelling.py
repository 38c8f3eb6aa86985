"""Incremental labelling as a stream: new articles arriving in the corpus
directory are labelled by a fitted model in micro-batches and appended to the
prediction store; ``maxFilesPerTrigger`` caps the work per batch.  A batch is one
commit that carries its batch id, so a batch that is run again after a failure adds
its rows once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from ..operators.trends import completion_offset
from ..plans.precompute import new_predictions, write_predictions
from ..sources.delta_store import PredictionStore


class _Stopped(Exception):
    """Raised at the start of a batch that is not to run any more."""


def run_labelling_stream(
    spark: SparkSession,
    articles_stream: DataFrame,
    model,
    table: str,
    checkpoint: str,
    corpus: DataFrame,
    timeout: float | None = None,
    stop: Callable[[], bool] | None = None,
) -> int:
    """Label every available article (``availableNow``) and stop; returns the
    number of rows appended.  Articles already in ``table`` are skipped.  Missing
    dates are reconstructed with the completion offset of ``corpus`` (a batch view
    of the whole corpus), computed once, so they do not depend on micro-batches.

    ``timeout`` (seconds) and ``stop()`` are read before every micro-batch: a batch
    that has begun is finished and committed, the next one does nothing and stays
    with the checkpoint, from which the next run goes on.
    """
    added: list[int] = []
    stopped = False
    start = time.monotonic()
    offset = completion_offset(corpus).checkpoint(eager=True)

    def label(batch: DataFrame, batch_id: int) -> None:
        nonlocal stopped
        if (timeout is not None and time.monotonic() - start >= timeout) or (stop is not None and stop()):
            stopped = True
            raise _Stopped
        store = PredictionStore(spark, table)
        existing = store.read() if store.exists() else None
        added.append(write_predictions(spark, new_predictions(model, batch, existing, offset=offset), table, batch=(checkpoint, batch_id)))

    q = (
        articles_stream.writeStream.foreachBatch(label)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            raise
    return sum(added)
