"""Incremental import as a stream: each new XML file is parsed once and
upserted into the corpus store; the stream checkpoint is the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import CorpusStore
from ..sources.medline import MEDLINE_SCHEMA, ROW_TAG, normalise, split_rejects
from ..functions.text import file_stem


def medline_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("xml").option("rowTag", ROW_TAG).schema(MEDLINE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.load(directory)
    return raw.withColumn("file_stem", file_stem(F.col("_metadata.file_path")))


def run_import_stream(
    spark: SparkSession,
    directory: str,
    store: CorpusStore,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
    rejects_path: str | None = None,
) -> int:
    """Process every file not yet seen (``availableNow``) and stop.

    Returns the number of micro-batches that carried data.  Running it again
    with the same checkpoint adds nothing.  Records without a numeric identifier
    go to ``rejects_path`` (beside the checkpoint unless given), one folder per
    micro-batch, so a repeated batch replaces its own.
    """
    rejects = (rejects_path or f"{checkpoint.rstrip('/')}_rejects").rstrip("/")
    batches = []

    def upsert(batch: DataFrame, batch_id: int) -> None:
        typed = normalise(batch).withColumn("_pos", F.monotonically_increasing_id()).checkpoint(eager=True)
        good, bad = split_rejects(typed)
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={int(batch_id)}")
        if not good.isEmpty():
            store.upsert(good, (checkpoint, int(batch_id)))
            batches.append(batch_id)

    q = (
        medline_stream(spark, directory, max_files_per_trigger)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return len(batches)
