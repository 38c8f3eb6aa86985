"""Trends from counts that are kept up to date.

A cube holds, per (label, date, completion day), how many predictions there are, and per
completion day how many articles.  Counts are additive: new predictions add cells, and
predictions that replace others add negative cells for those, so an increment costs the
new rows (and, where rows were replaced, one look at the replaced ones).  Spikes, label
trends and gap filling are answered from the cells: no query reads the predictions.

Both parts are delta tables (``sources.delta_store``) whose parts are summed on reading.
``advance`` follows the versions of a prediction store one by one and notes each in its
own commit, so an increment that dies, or comes twice, counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import calendar_bucket, resolution_unit
from ..operators import trends as TR
from ..sources import files
from ..sources.delta_store import DeltaTable, PredictionStore

STORE = "store version"


class CountCube(DeltaTable):
    """Counts ``n`` by the columns of ``dims``; parts add up."""

    def __init__(self, spark: SparkSession, path: str, dims: str, spread_by: str, partition_by: str | None = None):
        super().__init__(spark, path, f"{dims}, n bigint", spread_by, partition_by)
        self.dims = self.columns[:-1]

    def _merged(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        cells = self._scan([p["dir"] for p in parts]).groupBy(*self.dims).agg(F.sum("n").alias("n"))
        return cells.filter("n != 0").select(*self.columns)

    def counts(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        return rows.groupBy(*self.dims).agg((F.count(F.lit(1)) * F.lit(sign)).alias("n"))


class TrendCube:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        path = path.rstrip("/")
        self.cells = CountCube(spark, f"{path}/cells", "label int, date date, date_completed date", "date", "label")
        self.days = CountCube(spark, f"{path}/days", "date_completed date", "date_completed")

    # ------------------------------------------------------------ increments
    def add_articles(self, articles: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Count new articles by completion day (each article once; ``batch``: once)."""
        rows = articles.select(F.col("date_completed").cast("date").alias("date_completed")).filter("date_completed is not null")
        self.days.append(self.days.counts(rows), batch)

    def version(self) -> int:
        """The version of the prediction store that the cells stand for."""
        return self.cells.manifest()["batches"].get(STORE, -1)

    def advance(self, store: PredictionStore) -> int:
        """Follow ``store`` to its newest version; returns how many versions were new.
        Where the files of a version in between are gone the cells are counted anew."""
        todo = [v for v in store.versions() if v > self.version()]
        held = set(files.names_in(self.spark, f"{store.path}/data"))
        behind = [p["dir"] for v in [self.version(), *todo] if v >= 0 for p in store.manifest(v)["parts"]]
        if not set(behind) <= held:
            self.rebuild(store)
            return len(todo)
        for v in todo:
            self._follow(store, v)
        return len(todo)

    def _follow(self, store: PredictionStore, version: int) -> None:
        manifest = store.manifest(version)
        op, change = manifest["op"], self.spark.createDataFrame([], self.cells.schema)
        if op in ("append", "upsert", "replace") and manifest["parts"] and manifest["added"]:
            new = store._scan([manifest["parts"][-1]["dir"]])
            change = self.cells.counts(new)
            if op == "upsert" and version > 0:
                gone = store.read(version - 1).join(new.select(store.key), store.key, "left_semi")
                change = change.unionByName(self.cells.counts(gone, -1))
        if op == "replace" and version > 0:
            change = change.unionByName(self.cells.counts(store.read(version - 1), -1))
        sums = change.groupBy(*self.cells.dims).agg(F.sum("n").alias("n")).filter("n != 0")
        self.cells.append(sums, (STORE, version))

    def rebuild(self, store: PredictionStore) -> None:
        """Count the newest version of ``store`` from its rows."""
        version = store.versions()[-1]
        change = self.cells.counts(store.read(version)).unionByName(self.cells.read().withColumn("n", -F.col("n")))
        self.cells.append(change.groupBy(*self.cells.dims).agg(F.sum("n").alias("n")).filter("n != 0"), (STORE, version))

    # ------------------------------------------------------------ queries
    def docs_per_day(self) -> DataFrame:
        """``date, articles`` per completion day, zero-filled."""
        return TR._zero_filled(self._days(), "day", [])

    def _days(self) -> DataFrame:
        return self.days.read().select(F.col("date_completed").alias("date"), F.col("n").alias("articles"))

    def spikes(self, n: int) -> DataFrame:
        return TR.top_spike_dates(self._days(), n)

    def label_trend(self, resolution: str, labels: Sequence[int] | None = None, ignore_top_n_dates: int = 0) -> DataFrame:
        """``label, date, articles``: as ``operators.trends.label_trend`` of the
        predictions without those of the spike days."""
        resolution_unit(resolution)
        cells = self.cells.read().filter("date is not null")
        if labels is not None:
            cells = cells.filter(F.col("label").isin([int(x) for x in labels]))
        if ignore_top_n_dates > 0:
            cells = TR.drop_spike_dates(cells, self.spikes(ignore_top_n_dates), ignore_top_n_dates)
        return cells.groupBy("label", calendar_bucket("date", resolution).alias("date")).agg(F.sum("n").alias("articles"))

    def trend(self, resolution: str, labels: Sequence[int], ignore_top_n_dates: int = 0) -> DataFrame:
        """``date, label, articles``: as ``operators.trends.spike_filtered_trend``."""
        filled = TR.gap_fill(self.label_trend(resolution, labels, ignore_top_n_dates), resolution)
        return TR.trend_matrix(filled, labels).orderBy("date", "label")
