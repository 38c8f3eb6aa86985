"""Directory listings, file names and checksum verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_hrefs, file_stem
from .checksums import checksums


def hrefs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, pos, href`` - every link target of every listing page."""
    return pages.select(F.col(id_col), F.posexplode(extract_hrefs(html_col)).alias("pos", "href"))


def filter_sorted_names(names: DataFrame, suffix: str = ".gz", col: str = "name") -> DataFrame:
    """Distinct names ending with ``suffix``, ascending."""
    return names.select(col).filter(F.col(col).endswith(suffix)).distinct().orderBy(col)


def last_n(names: DataFrame, n: int, col: str = "name") -> DataFrame:
    """The last ``n`` names of the sorted listing (a top-n, not a scan)."""
    return names.orderBy(F.desc(col)).limit(int(n)).orderBy(col)


def list_files(spark: SparkSession, directory: str, glob: str = "*.gz") -> DataFrame:
    """``path, name, file_stem, length`` of the files under ``directory``
    (metadata only: the content column is pruned away)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), file_stem("path").alias("file_stem"), "length")


def verify_checksums(spark: SparkSession, directory: str, glob: str = "*.gz", files: DataFrame | None = None) -> DataFrame:
    """``path, name, file_stem, expected, actual, ok`` for every data file of
    ``directory``, or for ``files`` of its listing alone: only those, and their
    sidecars, are opened.

    The expected value is the second whitespace token of the ``<name>.md5`` sidecar
    (``MD5(name)= <hex>``), joined on the file name.  Files without a sidecar get
    ``ok = false``.
    """
    files = (list_files(spark, directory, glob) if files is None else files).filter(~F.col("name").endswith(".md5"))
    listed = files.select("path", "name", "file_stem")
    paths = [r["path"] for r in listed.select("path").collect()]  # metadata, one row per file
    data = listed.join(checksums(spark, paths).select("path", F.col("md5").alias("actual")), "path")
    asked = listed.select(F.concat("name", F.lit(".md5")).alias("sidecar"))
    there = list_files(spark, directory, "*.md5").join(asked, F.col("name") == F.col("sidecar"), "left_semi")
    beside = [r["path"] for r in there.select("path").collect()]
    side = (
        spark.read.format("text").option("wholetext", "true").load(beside).withColumn("_file", F.input_file_name())
        if beside
        else spark.createDataFrame([], "value string, _file string")
    )
    side = side.select(
        F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.md5$", "").alias("name"),
        F.lower(F.element_at(F.split(F.trim("value"), r"\s+"), 2)).alias("expected"),
    )
    j = data.join(side, "name", "left")
    return j.select(
        "path", "name", "file_stem", "expected", "actual",
        F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"),
    )
