"""Newline-delimited JSON: article and prediction exports and imports.

Bulk files may interleave action lines (``{"index": {"_id": ...}}``) with the
documents; those lines carry no ``PMID`` and are dropped by the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delta_store import PredictionStore

ARTICLE_JSON_SCHEMA = (
    "PMID bigint, DATE_REVISED date, DATE_COMPLETED date, KEYWORDS_MAJOR array<string>, "
    "KEYWORDS_MINOR array<string>, ARTICLE struct<ARTICLE_TITLE:string, ABSTRACT:string, LANGUAGE:string, "
    "ARTICLE_DATE:date, AUTHORS:array<struct<LAST_NAME:string, FIRST_NAME:string, COLLECTIVE_NAME:string>>>"
)

FILES_PER_STEM = 4

PREDICTION_SCHEMA = "pmid bigint, date date, date_completed date, label int"


def write_articles_json(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Articles as NDJSON, one directory per source file (``file_stem=...``)."""
    a = F.col("article")
    out = articles.select(
        F.col("pmid").alias("PMID"),
        F.col("date_revised").alias("DATE_REVISED"),
        F.col("date_completed").alias("DATE_COMPLETED"),
        F.col("keywords_major").alias("KEYWORDS_MAJOR"),
        F.col("keywords_minor").alias("KEYWORDS_MINOR"),
        F.struct(
            a["title"].alias("ARTICLE_TITLE"),
            a["abstract"].alias("ABSTRACT"),
            a["language"].alias("LANGUAGE"),
            a["article_date"].alias("ARTICLE_DATE"),
            F.transform(
                a["authors"],
                lambda x: F.struct(
                    x["last_name"].alias("LAST_NAME"),
                    x["first_name"].alias("FIRST_NAME"),
                    x["collective_name"].alias("COLLECTIVE_NAME"),
                ),
            ).alias("AUTHORS"),
        ).alias("ARTICLE"),
        "file_stem",
    )
    # a file's records come together first, so a folder has at most FILES_PER_STEM files
    dealt = out.repartition(F.col("file_stem"), F.pmod(F.xxhash64("PMID"), F.lit(FILES_PER_STEM)))
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("file_stem").option("dateFormat", "yyyy-MM-dd").json(path)


def read_articles_json(spark: SparkSession, path: str) -> DataFrame:
    """Articles from NDJSON (action lines skipped) in the ``articles`` shape."""
    raw = spark.read.schema(ARTICLE_JSON_SCHEMA).option("dateFormat", "yyyy-MM-dd").json(path)
    raw = raw.filter(F.col("PMID").isNotNull())
    a = F.col("ARTICLE")
    return raw.select(
        F.col("PMID").alias("pmid"),
        F.col("DATE_REVISED").alias("date_revised"),
        F.col("DATE_COMPLETED").alias("date_completed"),
        F.coalesce("KEYWORDS_MAJOR", F.array().cast("array<string>")).alias("keywords_major"),
        F.coalesce("KEYWORDS_MINOR", F.array().cast("array<string>")).alias("keywords_minor"),
        F.when(a.isNull(), F.lit(None)).otherwise(
            F.struct(
                a["ARTICLE_TITLE"].alias("title"),
                a["ABSTRACT"].alias("abstract"),
                a["LANGUAGE"].alias("language"),
                a["ARTICLE_DATE"].alias("article_date"),
                F.transform(
                    F.coalesce(a["AUTHORS"], F.array()),
                    lambda x: F.struct(
                        x["LAST_NAME"].alias("last_name"),
                        x["FIRST_NAME"].alias("first_name"),
                        x["COLLECTIVE_NAME"].alias("collective_name"),
                    ),
                ).alias("authors"),
            )
        ).alias("article"),
    )


def export_predictions(spark: SparkSession, table: str, path: str, mode: str = "overwrite") -> None:
    """Write a prediction table as NDJSON; a missing table is an error."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"Predictions table {table} does not exist")
    spark.table(table).write.mode(mode).option("dateFormat", "yyyy-MM-dd").json(path)


def import_predictions(
    spark: SparkSession, target_table: str, source_table: str | None = None, filepath: str | None = None
) -> DataFrame:
    """Replace ``target_table`` (a prediction store, label-partitioned as ``precompute``
    writes it) with predictions from exactly one of a table or an NDJSON path.
    Returns the new table."""
    if (source_table is None) == (filepath is None):
        raise ValueError("Exactly one of source_table and filepath must be given")
    if source_table is not None:
        df = spark.table(source_table)
    else:
        df = spark.read.schema(PREDICTION_SCHEMA).option("dateFormat", "yyyy-MM-dd").json(filepath)
        df = df.filter(F.col("pmid").isNotNull())
    # the source may be the target: its files stay until a vacuum
    store = PredictionStore(spark, target_table)
    store.replace(df.select("pmid", "date", "date_completed", "label"))
    return spark.table(target_table)
