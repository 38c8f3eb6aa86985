"""Model life cycle: draw a (cached) training sample, fit and save a model,
convert XML to NDJSON skipping files already converted, and list the models
that have prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import combine_text
from ..operators.sampling import sample
from ..sources import files as fl
from ..sources.listing import list_files
from ..sources.medline import flat_articles, normalise, read_medline_raw, split_rejects
from ..sources.ndjson import write_articles_json
from .embedding_topics import DocVectorTopicModel, EmbeddingTopicModel
from .topics import EntityTopicModel, TfidfTopicModel

MODELS = {"tfidf": TfidfTopicModel, "entity": EntityTopicModel, "embedding": EmbeddingTopicModel, "docvec": DocVectorTopicModel}


def predictions_table_name(source: str, model_name: str) -> str:
    return f"{source}_{model_name}_predictions"


def sample_cache_path(base: str, source: str, n_samples: int, method: str, seed: int | None,
                      combine_kwargs: dict | None = None) -> str:
    """Cache location keyed by every parameter that changes the sample."""
    flags = "-".join(f"{k}={int(bool(v))}" for k, v in sorted((combine_kwargs or {}).items())) or "default"
    return f"{base.rstrip('/')}/{source}/n={int(n_samples)}/method={method}/seed={seed}/flags={flags}"


def training_sample(
    spark: SparkSession,
    articles: DataFrame,
    n_samples: int,
    method: str = "uniform",
    seed: int | None = 0,
    combine_kwargs: dict | None = None,
    cache_path: str | None = None,
) -> DataFrame:
    """``pos, pmid, text``: ``n_samples`` articles (flat view) in scan order
    with their combined text.  With ``cache_path`` the sample is written once
    as parquet and read back on later calls; the path should encode the
    sampling parameters (the caller's key)."""
    if cache_path and fl.exists(spark, cache_path):
        return spark.read.parquet(cache_path)
    picked = sample(articles.select("pmid"), n_samples, method=method, key="pmid", seed=seed)
    kw = combine_kwargs or {}
    text = combine_text("title", "abstract", "keywords_major", "keywords_minor", **kw)
    out = picked.join(articles.select("pmid", text.alias("text")), "pmid").select("pos", "pmid", "text")
    if cache_path:
        out.write.mode("errorifexists").parquet(cache_path)
        return spark.read.parquet(cache_path)
    return out


def train(
    spark: SparkSession,
    articles: DataFrame,
    model_path: str,
    n_samples: int = 1_000_000,
    method: str = "uniform",
    seed: int | None = 0,
    combine_kwargs: dict | None = None,
    cache_dir: str | None = None,
    overwrite: bool = False,
    model: str | type = "tfidf",
    source: str = "articles",
    **model_kwargs,
):
    """Sample -> fit -> save (the ``train`` command) for any of ``MODELS`` or a class of
    the same interface.  ``cache_dir`` keeps samples by ``source`` and every parameter
    that changes them."""
    kind = MODELS.get(model) if isinstance(model, str) else model
    if kind is None:
        raise ValueError(f"unknown model {model!r}; expected one of {sorted(MODELS)}")
    cache = sample_cache_path(cache_dir, source, n_samples, method, seed, combine_kwargs) if cache_dir else None
    s = training_sample(spark, articles, n_samples, method, seed, combine_kwargs, cache)
    fitted = kind(combine_kwargs=combine_kwargs, **model_kwargs).fit(s.select(F.col("pmid").alias("doc_id"), "text"))
    fitted.save(model_path, overwrite=overwrite)
    return fitted


def extract_to_json(spark: SparkSession, input_dir: str, output_dir: str, overwrite: bool = False,
                    glob: str = "*.xml*", rejects_path: str | None = None) -> list[str]:
    """Convert every XML file to NDJSON (one output directory per input file,
    ``file_stem=<stem>``).  Files whose output exists are skipped unless
    ``overwrite``; returns the converted stems.  Records without a numeric
    identifier go to ``rejects_path`` (beside the output unless given)."""
    files = list_files(spark, input_dir, glob).filter(~F.col("name").endswith(".md5"))
    if not overwrite and fl.exists(spark, output_dir):
        done = [n.split("=", 1)[1] for n in fl.names_in(spark, output_dir) if n.startswith("file_stem=")]
        done_df = spark.createDataFrame([(s,) for s in done], "file_stem string")
        files = files.join(done_df, "file_stem", "left_anti")
    todo = files.select("path", "file_stem").collect()  # one row per file
    if not todo:
        return []
    arts, bad = split_rejects(normalise(read_medline_raw(spark, [r["path"] for r in todo])).checkpoint(eager=True))
    if not bad.isEmpty():
        bad.write.mode("append").parquet(rejects_path or f"{output_dir.rstrip('/')}_rejects")
    write_articles_json(arts, output_dir, mode="overwrite" if overwrite else "append")
    return sorted(r["file_stem"] for r in todo)


def models_with_predictions(spark: SparkSession, models_dir: str, source: str) -> DataFrame:
    """``model`` names (sub-directories of ``models_dir``) that have a
    ``<source>_<model>_predictions`` table in the catalog."""
    fs, p = fl.file_system(spark, models_dir)
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()] if fs.exists(p) else []
    models = spark.createDataFrame([(n,) for n in names], "model string")
    tables = spark.createDataFrame(
        [(t.name,) for t in spark.catalog.listTables(pattern=f"{source}_*_predictions")], "table string"
    )
    key = F.concat(F.lit(f"{source}_"), F.col("model"), F.lit("_predictions"))
    return models.join(tables, key == F.col("table"), "left_semi")


def remove_model(spark: SparkSession, model_path: str, model_name: str) -> list[str]:
    """Delete a saved model and drop all its prediction tables."""
    from ..operators.store import drop_model_tables

    if fl.exists(spark, model_path):
        fl.delete(spark, model_path)
    return drop_model_tables(spark, model_name)


__all__ = [
    "extract_to_json", "flat_articles", "models_with_predictions", "predictions_table_name", "remove_model",
    "train", "training_sample",
]
