"""TF-IDF -> truncated SVD -> k-means topic model.

``fit`` runs as Spark jobs end to end: the analyzer and TF-IDF are column
expressions and aggregations, the SVD is a randomized range finder made of
joins and aggregations (``operators.svd``), and the clustering is Spark ML
``KMeans`` (k-means|| initialisation).  The driver holds only the model:
vocabulary indices are a DataFrame; ``V`` (vocabulary x components) and the
centres (clusters x components) are small dense matrices.

Stages, in order, for ``transform(last_step=..., exclude_from=...)``:
``vectorize`` (long-form TF-IDF ``doc_id, idx, w``), ``reduce`` (``doc_id,
vector``) and ``clustering`` (``doc_id, distances`` to every centre).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import DISTANCES
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import trends as TR
from ..operators import vectors as V
from ..operators.common import bounded_broadcast, written
from ..operators.sampling import scan_positions
from ..operators.svd import randomized_svd, times_matrix
from ..session import ensure_checkpoint_dir

STAGES = ("vectorize", "reduce", "clustering")


def _stage_index(last_step: str | None, exclude_from: str | None) -> int:
    """Number of stages to run."""
    if last_step is not None and exclude_from is not None:
        raise ValueError("give at most one of last_step and exclude_from")
    if last_step is not None:
        if last_step not in STAGES:
            raise ValueError(f"unknown stage {last_step!r}")
        return STAGES.index(last_step) + 1
    if exclude_from is not None:
        if exclude_from not in STAGES:
            raise ValueError(f"unknown stage {exclude_from!r}")
        return STAGES.index(exclude_from)
    return len(STAGES)


class TfidfTopicModel:
    """``tokenizer`` names a registered tokenizer (``functions.analyzers``)."""

    def __init__(
        self,
        stop_words: str | None = "english",
        ngram_range: tuple[int, int] = (1, 1),
        min_df: float | int = 1,
        max_df: float | int = 1.0,
        n_components: int = 100,
        n_clusters: int = 100,
        random_state: int = 0,
        n_name_terms: int = 3,
        max_iter: int = 20,
        combine_kwargs: dict | None = None,
        tokenizer: str | None = None,
    ):
        self.config = dict(
            combine_kwargs=dict(combine_kwargs or {}),
            tokenizer=tokenizer,
            stop_words=stop_words,
            ngram_range=list(ngram_range),
            min_df=min_df,
            max_df=max_df,
            n_components=int(n_components),
            n_clusters=int(n_clusters),
            random_state=int(random_state),
            n_name_terms=int(n_name_terms),
            max_iter=int(max_iter),
        )
        self.vocab: DataFrame | None = None  # term, idx, idf
        self.components: DataFrame | None = None  # idx, v (d rows, k values)
        self.n_terms = 0
        self.centers: np.ndarray | None = None  # c x k
        self.names: DataFrame | None = None  # label, name
        self.kmeans = None  # the fitted Spark ML KMeansModel

    @property
    def combine_kwargs(self) -> dict:
        """The text parts the model was trained on; labelling uses the same."""
        return self.config["combine_kwargs"]

    # ------------------------------------------------------------ building blocks
    def _term_counts(self, docs: DataFrame) -> DataFrame:
        c = self.config
        return FE.term_counts(docs, "doc_id", "text", c["stop_words"], tuple(c["ngram_range"]), c["tokenizer"])

    def _vectorize(self, docs: DataFrame) -> DataFrame:
        if self.vocab is None:
            raise ValueError("model is not fitted")
        tf = self._term_counts(docs)
        w = tf.join(bounded_broadcast(self.vocab, self.n_terms or None), "term").select("doc_id", "idx", (F.col("tf") * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
        return w.select("doc_id", "idx", (F.col("w") / norm).alias("w"))

    @property
    def n_components(self) -> int:
        return int(self.centers.shape[1]) if self.centers is not None else int(self._k)

    def _reduce(self, docs: DataFrame, x: DataFrame) -> DataFrame:
        k = self._k
        y = times_matrix(x, self.components, docs.sparkSession, self.n_terms, k)
        zero = F.array_repeat(F.lit(0.0), k)
        return docs.select("doc_id").join(y, "doc_id", "left").select(
            "doc_id", F.coalesce(F.col("y"), zero).alias("vector")
        )

    def centres_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(int(i), [float(v) for v in c]) for i, c in enumerate(self.centers)]
        return spark.createDataFrame(rows, "label int, center array<double>")

    # ------------------------------------------------------------ API
    def fit(self, docs: DataFrame) -> "TfidfTopicModel":
        """Fit on ``docs(doc_id, text)``; also computes the cluster names."""
        spark = docs.sparkSession
        ensure_checkpoint_dir(spark)
        c = self.config
        docs = docs.select("doc_id", "text")
        n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
        tf = self._term_counts(docs)
        kept = written(FE.pruned_vocab(FE.doc_freq(tf), n_docs, c["min_df"], c["max_df"]), "kept-terms")
        # term indices 0..d-1 in term order, numbered with distributed scan
        # positions (range partitioning + per-partition offsets): with an
        # absolute min_df the vocabulary grows with the corpus
        numbered = scan_positions(kept.select("term", "idf"), "term")
        self.vocab = written(numbered.select("term", F.col("pos").cast("int").alias("idx"), "idf"), "model-terms")
        self.n_terms = d = self.vocab.count()
        if d == 0:
            raise ValueError("empty vocabulary after pruning")
        # the document-term matrix is read by every SVD pass: written once
        x = written(self._vectorize(docs), "document-terms")
        k = min(c["n_components"], d)
        self._k = k
        self.components, self.singular_values = randomized_svd(x, d, k, seed=c["random_state"])
        reduced = written(self._reduce(docs, x), "reduced")
        km = KMeans(k=c["n_clusters"], seed=c["random_state"], maxIter=c["max_iter"], featuresCol="features")
        km_model = km.fit(reduced.select(array_to_vector("vector").alias("features")))
        self.kmeans = km_model
        self.centers = np.array([np.asarray(v) for v in km_model.clusterCenters()])
        labels = written(self._assign(reduced), "train-labels")
        weights = x.join(bounded_broadcast(self.vocab.select("term", "idx"), d), "idx").select("doc_id", "term", F.col("w").alias("tfidf"))
        self.names = written(FE.cluster_names(
            FE.cluster_term_weights(weights, labels.select("doc_id", "label")), c["n_name_terms"], ", "
        ), "topic-names")
        self.train_labels = labels
        return self

    def _assign(self, reduced: DataFrame) -> DataFrame:
        """Nearest centre per document.  With the fitted ``KMeansModel`` this
        is its JVM ``transform`` (BLAS distances, first centre wins ties);
        otherwise the centres are scored with column expressions."""
        if self.kmeans is not None:
            out = self.kmeans.transform(reduced.withColumn("features", array_to_vector("vector")))
            return out.select("doc_id", F.col("prediction").cast("int").alias("label"), "vector")
        centres = self.centres_frame(reduced.sparkSession)
        return V.assign_nearest(reduced, centres, "vector", "euclidean").select("doc_id", "label", "vector")

    def transform(self, docs: DataFrame, last_step: str | None = None, exclude_from: str | None = None) -> DataFrame:
        n = _stage_index(last_step, exclude_from)
        docs = docs.select("doc_id", "text")
        if n == 0:
            return docs
        x = self._vectorize(docs)
        if n == 1:
            return x
        reduced = self._reduce(docs, x)
        if n == 2:
            return reduced
        # one row per document: distances to every centre, in label order
        with_c = V.with_centres(reduced, self.centres_frame(docs.sparkSession))
        scores = V.centre_scores("vector", F.col("_centres"), "euclidean")
        return with_c.select("doc_id", F.transform(scores, lambda s: s["distance"]).alias("distances"))

    def predict(self, docs: DataFrame) -> DataFrame:
        """``doc_id, label`` - the nearest centre of each document."""
        return self._assign(self.transform(docs, exclude_from="clustering")).select("doc_id", "label")

    def evaluate(self, docs: DataFrame, labels: DataFrame | None = None, scores=None, transformed: bool = False) -> DataFrame:
        """One row of cluster scores on the reduced vectors (labels predicted
        unless given as ``doc_id, label``; ``transformed``: ``docs`` is ``doc_id,
        vector``)."""
        reduced = docs.select("doc_id", "vector") if transformed else written(self.transform(docs, exclude_from="clustering"), "reduced")
        lab = labels if labels is not None else self._assign(reduced).select("doc_id", "label")
        # every score reads the points twice
        pts = written(reduced.join(lab.select("doc_id", "label"), "doc_id"), "labelled-points")
        return E.evaluate_clusters(pts, "label", "vector", scores)

    def query_vector(self, spark: SparkSession, query: str) -> list[float]:
        """Reduced vector of one query text (one row comes back to the driver)."""
        q = spark.createDataFrame([(0, query)], "doc_id long, text string")
        row = self.transform(q, exclude_from="clustering").first()
        return [float(v) for v in row["vector"]]

    def closest_labels(self, spark: SparkSession, query: str, closest_n: int = 1, distance: str = "cosine") -> list[int]:
        if distance not in DISTANCES:
            raise ValueError(f"Invalid distance: {distance}")
        qv = self.query_vector(spark, query)
        near = V.nearest_topics(self.centres_frame(spark), qv, closest_n, distance)
        return [int(r["label"]) for r in near.select("label").collect()]

    def generate_trends(
        self,
        query: str,
        resolution: str,
        articles: DataFrame,
        predictions: DataFrame,
        distance: str = "cosine",
        closest_n: int = 1,
        ignore_top_n_dates: int = 0,
    ) -> DataFrame:
        """``date, label, articles`` for the clusters closest to ``query``."""
        labels = self.closest_labels(articles.sparkSession, query, closest_n, distance)
        return TR.spike_filtered_trend(articles, predictions, resolution, labels, ignore_top_n_dates)

    # ------------------------------------------------------------ persistence
    def save(self, path: str, overwrite: bool = False, save_only: Sequence[str] | None = None) -> None:
        """Write config, vocabulary, components, centres and names under ``path``.
        ``save_only`` limits the parts written (``config``, ``model``, ``names``)."""
        spark = self.vocab.sparkSession
        parts = set(save_only or ("config", "model", "names"))
        mode = "overwrite" if overwrite else "errorifexists"
        if "config" in parts:
            spark.createDataFrame([(json.dumps(self.config),)], "config string").coalesce(1).write.mode(mode).json(
                f"{path}/config"
            )
        if "model" in parts:
            self.vocab.write.mode(mode).parquet(f"{path}/vocab")
            self.components.write.mode(mode).parquet(f"{path}/components")
            self.centres_frame(spark).write.mode(mode).parquet(f"{path}/centers")
            if self.kmeans is not None:
                w = self.kmeans.write()
                (w.overwrite() if overwrite else w).save(f"{path}/kmeans")
        if "names" in parts:
            self.names.coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/names")

    @classmethod
    def _load_parts(cls, spark: SparkSession, path: str) -> dict:
        """Constructor arguments that are not in the saved config."""
        return {}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfTopicModel":
        cfg = json.loads(spark.read.json(f"{path}/config").first()["config"])
        cfg["ngram_range"] = tuple(cfg["ngram_range"])
        m = cls(**cls._load_parts(spark, path), **cfg)
        m.vocab = spark.read.parquet(f"{path}/vocab")
        m.components = spark.read.parquet(f"{path}/components")
        cen = spark.read.parquet(f"{path}/centers").orderBy("label").collect()
        m.centers = np.array([r["center"] for r in cen])
        m._k = int(m.centers.shape[1])
        m.n_terms = m.vocab.count()
        from pyspark.ml.clustering import KMeansModel

        from ..sources.files import exists

        # saved without the k-means model: score centres directly
        m.kmeans = KMeansModel.load(f"{path}/kmeans") if exists(spark, f"{path}/kmeans") else None
        m.names = spark.read.option("header", True).schema("label int, name string").csv(f"{path}/names")
        return m


class EntityTopicModel(TfidfTopicModel):
    """The TF-IDF topic model over each document's dictionary entities
    (``operators.entities``) instead of its full text; the query of a trend
    request is preprocessed the same way, once."""

    def __init__(self, dictionary: DataFrame | None = None, max_entity_len: int = 3, extractor=None, **kwargs):
        super().__init__(**kwargs)
        if dictionary is None and extractor is None:
            raise ValueError("give a phrase dictionary or an entity extractor")
        self.dictionary = dictionary
        self.extractor = extractor  # optional pandas Series -> Series (e.g. an NER model)
        self.config["max_entity_len"] = int(max_entity_len)

    def _entities(self, docs: DataFrame) -> DataFrame:
        from ..operators.entities import entity_text, entity_text_with

        if self.extractor is not None:
            return entity_text_with(docs.select("doc_id", "text"), self.extractor)
        return entity_text(docs.select("doc_id", "text"), self.dictionary, self.config["max_entity_len"])

    def fit(self, docs: DataFrame) -> "EntityTopicModel":
        # found once: every pass over the documents reads them again
        return super().fit(written(self._entities(docs), "entities"))

    def transform(self, docs: DataFrame, last_step: str | None = None, exclude_from: str | None = None) -> DataFrame:
        return super().transform(self._entities(docs), last_step, exclude_from)

    def save(self, path: str, overwrite: bool = False, save_only: Sequence[str] | None = None) -> None:
        super().save(path, overwrite, save_only)
        parts = set(save_only or ("config", "model", "names"))
        if "model" in parts and self.dictionary is not None:
            self.dictionary.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/dictionary")

    @classmethod
    def _load_parts(cls, spark: SparkSession, path: str) -> dict:
        from ..sources.files import exists

        if exists(spark, f"{path}/dictionary"):
            return {"dictionary": spark.read.parquet(f"{path}/dictionary")}
        if cls._extractor is None:
            raise ValueError("the model was saved with an extractor; give it to load")
        return {"extractor": cls._extractor}

    _extractor = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, extractor=None) -> "EntityTopicModel":
        """A saved model; one that used an extractor needs it again, since code is
        not saved."""
        kind = type(cls.__name__, (cls,), {"_extractor": staticmethod(extractor)}) if extractor is not None else cls
        m = super(EntityTopicModel, kind).load(spark, path)
        m.__class__ = cls
        return m
