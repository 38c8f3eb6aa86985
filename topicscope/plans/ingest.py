"""Corpus ingestion: a versioned article store with keyed upserts, the ledger
of imported files, and the end-to-end batch import.

Storage is plain parquet under a commit manifest (``sources.delta_store``): an upsert
writes its own records as a delta and commits it by one rename, and readers merge the
deltas of the newest committed version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.delta_store import DeltaTable
from ..sources.files import delete, exists
from ..sources.listing import list_files, verify_checksums
from ..sources.medline import normalise, read_medline_raw, split_rejects


def keep_latest(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """One row per ``key``: the row with the greatest ``order_cols``.

    ``max_by`` is a partial aggregate, so a key with many versions shuffles
    one row per task, not all of its versions into one task.
    """
    cols = df.columns
    packed = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_v"))
    return packed.select("_v.*")


def record_order(df: DataFrame) -> list[str]:
    """What decides between records of one key: the load, then the file name,
    then the position in the file (split packing does not follow file names)."""
    return ["load_seq", *(["file_stem"] if "file_stem" in df.columns else []), "_pos"]


class CorpusStore:
    """Table of articles keyed by ``pmid`` (last write wins): a base and deltas
    (``sources.delta_store``), so an import costs its own records."""

    def __init__(self, spark: SparkSession, base_path: str):
        self.spark = spark
        self.base = base_path.rstrip("/")
        self._table: DeltaTable | None = None

    def _open(self, columns: DataFrame | None = None) -> DeltaTable | None:
        """The table; its columns are those of the first batch written to it."""
        if self._table is None:
            if exists(self.spark, f"{self.base}/commits"):
                part = next((p["dir"] for p in DeltaTable(self.spark, self.base, "pmid bigint").manifest()["parts"]), None)
                if part is not None:
                    columns = self.spark.read.parquet(f"{self.base}/data/{part}")
            if columns is None:
                return None
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields)
            self._table = DeltaTable(self.spark, self.base, ddl)
        return self._table

    def versions(self) -> list[int]:
        table = self._open()
        return table.versions() if table is not None else []

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def read(self) -> DataFrame | None:
        table = self._open()
        return table.read() if table is not None and table.exists() else None

    def is_empty(self) -> bool:
        df = self.read()
        return df is None or df.isEmpty()

    def upsert(self, articles: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        """Merge ``articles`` (latest record per pmid wins, within the batch by
        ``record_order``); returns the newest version number.  ``batch``: (stream
        name, batch id), merged once."""
        v = self.current_version()
        new = articles.withColumn("load_seq", F.lit(0 if v is None else v + 1).cast("int"))
        if "_pos" not in new.columns:
            new = new.withColumn("_pos", F.monotonically_increasing_id())
        merged = keep_latest(new, "pmid", record_order(new))
        self._open(merged).upsert(merged, batch)
        return self.current_version()


class BucketedCorpusStore:
    """Article table partitioned by identifier range (``pmid_bucket =
    pmid // bucket_width``) for large corpora.

    An upsert touches only the buckets present in the new batch: their
    current rows are read with partition pruning, merged with the batch
    (latest record per pmid wins), staged by a checkpoint (so the write never
    reads what it replaces) and written back with dynamic partition
    overwrite.  Cost per import is proportional to the touched buckets, not to
    the corpus.  Update files mostly carry new, increasing identifiers, so
    they touch few buckets.
    """

    BUCKET = "pmid_bucket"

    def __init__(self, spark: SparkSession, path: str, bucket_width: int = 100_000):
        self.spark = spark
        self.path = path.rstrip("/")
        self.width = int(bucket_width)

    def read(self) -> DataFrame | None:
        if not exists(self.spark, self.path):
            return None
        return self.spark.read.parquet(self.path)

    def is_empty(self) -> bool:
        df = self.read()
        return df is None or df.isEmpty()

    def current_version(self) -> int | None:
        return None

    def upsert(self, articles: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Merge ``articles`` into the touched buckets; returns the number of
        buckets rewritten.  Merging a ``batch`` again changes nothing."""
        new = articles.withColumn(self.BUCKET, F.floor(F.col("pmid") / F.lit(self.width)).cast("long"))
        if "_pos" not in new.columns:
            new = new.withColumn("_pos", F.monotonically_increasing_id())
        new = new.withColumn("load_seq", F.lit(0).cast("long"))
        cur = self.read()
        if cur is not None:
            # one row per touched bucket
            touched = [r[0] for r in new.select(self.BUCKET).distinct().collect()]
            old = cur.filter(F.col(self.BUCKET).isin(touched))  # partition pruning
            seq = old.agg(F.max("load_seq")).first()[0]
            new = new.withColumn("load_seq", F.lit((seq if seq is not None else -1) + 1).cast("long"))
            new = old.unionByName(new.select(*old.columns))
        merged = keep_latest(new, "pmid", record_order(new)).checkpoint(eager=True)
        n_buckets = merged.select(self.BUCKET).distinct().count()
        merged.repartition(self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.BUCKET).parquet(self.path)
        return n_buckets


class Ledger:
    """The set of imported file stems (parquet at ``path``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "file_stem string")
        return self.spark.read.parquet(self.path)

    def register(self, stems: DataFrame) -> None:
        """Add stems (set semantics: only stems not yet present are appended)."""
        new = stems.select("file_stem").distinct().join(self.read(), "file_stem", "left_anti")
        new = new.checkpoint(eager=True)  # the append must not read what it writes
        new.write.mode("append").parquet(self.path)

    def pending(self, files: DataFrame) -> DataFrame:
        """Files whose stem has not been imported."""
        return files.join(self.read().select("file_stem"), "file_stem", "left_anti")

    def reset(self) -> None:
        if exists(self.spark, self.path):
            delete(self.spark, self.path)

    def reset_if_target_empty(self, store: CorpusStore) -> bool:
        """Forget every import when the corpus is missing or empty."""
        if store.is_empty():
            self.reset()
            return True
        return False


def import_directory(
    spark: SparkSession,
    directory: str,
    store: CorpusStore,
    ledger: Ledger,
    last_n_files: int | None = None,
    verify: bool = False,
    glob: str = "*.xml*",
    rejects_path: str | None = None,
) -> dict:
    """List -> last n -> not yet imported -> checksum -> parse -> upsert -> register.

    Returns a small report; ``rejects`` counts this import's records without a
    numeric identifier, which are kept in ``rejects_path`` if given.
    """
    ledger.reset_if_target_empty(store)
    files = list_files(spark, directory, glob).filter(~F.col("name").endswith(".md5"))
    if last_n_files is not None:
        files = files.orderBy(F.desc("name")).limit(int(last_n_files))
    pending = ledger.pending(files)
    quarantined: list[str] = []
    if verify:
        # files in the ledger are not opened again
        checks = verify_checksums(spark, directory, glob, pending).checkpoint(eager=True)
        checked = pending.join(checks.select("path", "ok"), "path")
        quarantined = [r["path"] for r in checked.filter(~F.col("ok")).select("path").collect()]
        pending = checked.filter(F.col("ok")).drop("ok")
    # the list of file paths (metadata, one row per file) is what the reader needs
    paths = [r["path"] for r in pending.select("path").orderBy("path").collect()]
    report = {"files": len(paths), "quarantined": quarantined, "version": store.current_version(), "rejects": 0}
    if not paths:
        return report
    # _pos: record order inside each file (the projection keeps the split order);
    # parsed once, then read by both outputs
    typed = normalise(read_medline_raw(spark, paths)).withColumn("_pos", F.monotonically_increasing_id()).checkpoint(eager=True)
    good, bad = split_rejects(typed)
    report["rejects"] = bad.count()
    if rejects_path and report["rejects"]:
        bad.write.mode("append").parquet(rejects_path)
    report["version"] = store.upsert(good)
    ledger.register(pending.select("file_stem"))
    return report
