"""Table maintenance: keyed upsert (last write wins), latest record per key,
anti joins against what is already done, the import ledger and table
lifecycle helpers.

Latest-per-key uses ``max(struct(seq, ...))`` grouped by key, which is
partially aggregated on the map side: a key with millions of versions costs
one row per task in the shuffle, unlike a ``row_number()`` window, which would
pull all versions of that key into one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per ``key``: the one with the largest ``seq`` (ties: the largest
    remaining column values, so the choice is deterministic)."""
    others = [c for c in df.columns if c not in (key, seq)]
    packed = df.groupBy(key).agg(F.max(F.struct(seq, *others)).alias("_v"))
    return packed.select(key, *[F.col("_v")[c].alias(c) for c in [seq, *others]])


def upsert_latest(current: DataFrame, updates: DataFrame, key: str = "pmid", seq: str = "seq") -> DataFrame:
    """``current`` upserted with ``updates``: per key the row with the highest
    ``seq``; on equal ``seq`` the update wins."""
    cols = current.columns
    both = current.select(*cols, F.lit(0).alias("_src")).unionByName(
        updates.select(*cols, F.lit(1).alias("_src"))
    )
    others = [c for c in cols if c not in (key, seq)]
    packed = both.groupBy(key).agg(F.max(F.struct(seq, "_src", *others)).alias("_v"))
    return packed.select(key, *[F.col("_v")[c].alias(c) for c in [seq, *others]])


def unpredicted(corpus: DataFrame, predictions: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows of ``corpus`` whose key has no prediction yet (left anti join)."""
    return corpus.join(predictions.select(key), key, "left_anti")


def pending_files(listed: DataFrame, ledger: DataFrame, col: str = "file_stem") -> DataFrame:
    """Listed files whose stem is not in the ledger."""
    return listed.select(col).distinct().join(ledger.select(col), col, "left_anti")


def ledger_register(ledger: DataFrame, new: DataFrame, col: str = "file_stem") -> DataFrame:
    """The ledger with the new stems added (set union)."""
    return ledger.select(col).unionByName(new.select(col)).distinct()


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows`` for each table (parquet counts come from footers)."""
    parts = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- table lifecycle
def create_table_if_absent(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    loc = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{loc}")


PREDICTIONS_SCHEMA = "pmid bigint, date date, date_completed date, label int"


def ensure_predictions_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """Create the prediction table (explicit schema, partitioned by label) if absent."""
    loc = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PREDICTIONS_SCHEMA}) USING parquet PARTITIONED BY (label){loc}")


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table or a published prediction store; a missing one is no error."""
    from ..sources.delta_store import PredictionStore

    if not spark.catalog.tableExists(name):
        return
    if spark.catalog.getTable(name).tableType == "VIEW":
        PredictionStore(spark, name).drop()
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_model_tables(spark: SparkSession, model_name: str) -> list[str]:
    """Drop every ``*_<model>_predictions`` table; returns the dropped names."""
    dropped = []
    for t in spark.catalog.listTables(pattern=f"*_{model_name}_predictions"):
        if t.isTemporary:
            continue
        drop_table(spark, t.name)
        dropped.append(t.name)
    return dropped


def table_is_empty(spark: SparkSession, name: str) -> bool:
    return (not spark.catalog.tableExists(name)) or spark.table(name).isEmpty()


def write_versioned(df: DataFrame, base_path: str, version: int, mode: str = "errorifexists") -> str:
    """Write ``df`` to ``<base>/v=<version>`` (never over the path being read)."""
    path = f"{base_path.rstrip('/')}/v={int(version)}"
    df.write.mode(mode).parquet(path)
    return path
