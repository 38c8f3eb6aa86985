"""Medline citation XML (plain or gzip-compressed) -> ``articles`` DataFrame.

The reader schema is explicit and deliberately loose: every leaf is a string
and every repeatable element an array.  A typed leaf holding a bad value (a
month written ``Jan``) would null every later field of its record, and a
repeated element declared as a struct keeps only its last occurrence, while
the first is the one wanted.  Types are applied afterwards with ``try_*``
casts, so one bad record never loses the file; records without a usable
identifier go to the rejects output.

Compressed files are decompressed by the reader (one ``.gz`` file is one
split, hence the repartition by ``pmid`` after the parse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import assemble_date
from ..functions.text import file_stem, split_flagged, strip_inline_markup

ROW_TAG = "MedlineCitation"

_DATE = "struct<Year:string,Month:string,Day:string>"
MEDLINE_SCHEMA = (
    "PMID struct<_VALUE:string>, "
    f"DateCompleted {_DATE}, "
    f"DateRevised {_DATE}, "
    "KeywordList array<struct<Keyword:array<struct<_MajorTopicYN:string,_VALUE:string>>>>, "
    "Article struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>, "
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string>>>, "
    f"Language:array<string>, ArticleDate:array<{_DATE}>>"
)

ARTICLE_COLUMNS = (
    "pmid", "date_revised", "date_completed", "keywords_major", "keywords_minor", "article", "file_stem"
)


def read_medline_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw citations (reader schema) plus the source ``file_stem``."""
    reader = spark.read.format("xml").option("rowTag", ROW_TAG).schema(MEDLINE_SCHEMA)
    df = reader.load(path)
    return df.withColumn("file_stem", file_stem(F.col("_metadata.file_path")))


def _date(s) -> F.Column:
    return assemble_date(s["Year"], s["Month"], s["Day"])


def _text(c) -> F.Column:
    # element text with inline markup dropped; absent -> ''
    return F.coalesce(strip_inline_markup(c), F.lit(""))


def normalise(raw: DataFrame) -> DataFrame:
    """Typed ``articles`` rows (``pmid`` may be NULL: see ``split_rejects``)."""
    art = F.col("Article")
    kw = F.try_element_at(F.col("KeywordList"), F.lit(1))["Keyword"]
    major, minor = split_flagged(kw, "_MajorTopicYN", "_VALUE")
    parts = F.coalesce(art["Abstract"]["AbstractText"], F.array().cast("array<string>"))
    authors = F.coalesce(art["AuthorList"]["Author"], F.array())
    article = F.when(art.isNull(), F.lit(None)).otherwise(
        F.struct(
            _text(art["ArticleTitle"]).alias("title"),
            F.array_join(F.transform(parts, lambda p: _text(p)), " ").alias("abstract"),
            F.coalesce(F.try_element_at(art["Language"], F.lit(1)), F.lit("")).alias("language"),
            _date(F.try_element_at(art["ArticleDate"], F.lit(1))).alias("article_date"),
            F.transform(
                authors,
                lambda a: F.struct(
                    F.coalesce(a["LastName"], F.lit("")).alias("last_name"),
                    F.coalesce(a["ForeName"], F.lit("")).alias("first_name"),
                    F.coalesce(a["CollectiveName"], F.lit("")).alias("collective_name"),
                ),
            ).alias("authors"),
        )
    )
    return raw.select(
        F.col("PMID")["_VALUE"].try_cast("bigint").alias("pmid"),
        _date(F.col("DateRevised")).alias("date_revised"),
        _date(F.col("DateCompleted")).alias("date_completed"),
        major.alias("keywords_major"),
        minor.alias("keywords_minor"),
        article.alias("article"),
        "file_stem",
    )


def split_rejects(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows): a record without a numeric PMID is rejected."""
    return articles.filter(F.col("pmid").isNotNull()), articles.filter(F.col("pmid").isNull())


def read_medline(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Good ``articles`` rows of the given XML / XML.gz file(s), hash-partitioned
    by ``pmid`` (each gz file arrives as a single split)."""
    good, _ = split_rejects(normalise(read_medline_raw(spark, path)))
    n = partitions or spark.sparkContext.defaultParallelism
    return good.repartition(n, "pmid")


def flat_articles(articles: DataFrame) -> DataFrame:
    """Flat view used by the trend and feature code: ``pmid, title, abstract,
    language, article_date, date_completed, date_revised, keywords_major,
    keywords_minor``."""
    a = F.col("article")
    return articles.select(
        "pmid",
        F.coalesce(a["title"], F.lit("")).alias("title"),
        F.coalesce(a["abstract"], F.lit("")).alias("abstract"),
        F.coalesce(a["language"], F.lit("")).alias("language"),
        a["article_date"].alias("article_date"),
        "date_completed",
        "date_revised",
        "keywords_major",
        "keywords_minor",
    )
