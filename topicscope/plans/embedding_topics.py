"""Density topic models over dense vectors.

``EmbeddingTopicModel`` takes document embeddings as ``array<float>``, reduces them
with the truncated SVD of ``operators.svd``, clusters the reduced vectors by density
(noise = -1) and represents each topic by the mean embedding of its members.  Topic
names are ``<id>_w1_w2_w3_w4`` from class-based TF-IDF over the members' text.  The
sentence encoder runs outside: ``encoder`` is a DataFrame -> DataFrame function from
``doc_id, text`` to ``doc_id, embedding`` (``stored_vectors`` looks vectors up by
``doc_id``), so that texts can be labelled in bulk and trends asked for by text.

``DocVectorTopicModel`` derives word vectors from co-occurrence counts
(``operators.cooccurrence``); a document is the mean of its words' vectors, documents
are clustered as above, and a topic is named by the words whose vectors are closest to
it.  Words, documents, topics and queries share one space.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import euclidean
from ..operators import cooccurrence as CO
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import trends as TR
from ..operators import vectors as V
from ..operators.common import written
from ..operators.density import grid_clusters
from ..operators.density_tree import density_clusters
from ..operators.svd import projected, randomized_svd

Encoder = Callable[[DataFrame], DataFrame]
PARTS = ("config", "model", "names")


def stored_vectors(vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> Encoder:
    """An encoder that looks up each document's stored vector."""
    known = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("embedding"))
    return lambda docs: docs.select("doc_id").join(known, "doc_id", "left")


def _long_form(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.col(vec_col).cast("array<double>")).alias("idx", "w")
    ).filter(F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") != 0))


def _write_config(spark: SparkSession, config: dict, path: str, mode: str) -> None:
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode(mode).json(f"{path}/config")


def _saved_parts(save_only: Sequence[str] | None) -> set[str]:
    parts = set(PARTS if save_only is None else save_only)
    if not parts <= set(PARTS):
        raise ValueError(f"unknown parts {sorted(parts - set(PARTS))}; expected some of {PARTS}")
    return parts


class EmbeddingTopicModel:
    """``cell_size`` clusters on a grid of that cell size instead (one pass over the
    points; see ``operators.density``)."""

    def __init__(
        self,
        n_components: int = 5,
        min_points: int = 10,
        min_cluster_size: int | None = None,
        neighbours: int | None = None,
        cell_size: float | None = None,
        radius: float | None = None,
        n_name_words: int = 4,
        random_state: int = 0,
        combine_kwargs: dict | None = None,
        encoder: Encoder | None = None,
    ):
        self.config = dict(
            n_components=int(n_components),
            min_points=int(min_points),
            min_cluster_size=min_cluster_size,
            neighbours=neighbours,
            cell_size=cell_size,
            radius=radius,
            n_name_words=int(n_name_words),
            random_state=int(random_state),
            combine_kwargs=dict(combine_kwargs or {}),
        )
        self.encoder = encoder
        self.components: DataFrame | None = None  # idx, v
        self._d = 0
        self._k = 0
        self.topic_vectors: DataFrame | None = None  # label, center (original space)
        self.names: DataFrame | None = None
        self.labels: DataFrame | None = None

    @property
    def combine_kwargs(self) -> dict:
        return self.config["combine_kwargs"]

    def _vectors(self, docs: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
        """``doc_id, embedding`` given as such, or by the encoder from texts."""
        if vec_col in docs.columns:
            out = docs.select(F.col(id_col).alias("doc_id"), F.col(vec_col).alias("embedding"))
        elif self.encoder is not None:
            out = self.encoder(docs.select(F.col(id_col).alias("doc_id"), "text"))
        else:
            raise ValueError(f"no column {vec_col!r}, and the model has no encoder for texts")
        return out.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def _reduce(self, vectors: DataFrame) -> DataFrame:
        """``doc_id, vector``: the vectors times the components, in one map (nulls, NaN and
        numbers beyond the model's width count as 0)."""
        return vectors.select("doc_id", projected("embedding", self.components, self._d, self._k).alias("vector"))

    def fit(self, vectors: DataFrame, docs: DataFrame | None = None, id_col: str = "doc_id", vec_col: str = "embedding"):
        """Fit on ``vectors(id, embedding)``, or texts where the model has an encoder;
        ``docs(doc_id, text)`` names the topics.  Rows without a vector are noise."""
        c = self.config
        if docs is None and "text" in vectors.columns:
            docs = vectors.select(F.col(id_col).alias("doc_id"), "text")
        vectors = written(self._vectors(vectors, id_col, vec_col), "vectors")
        d = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        if d <= 0:
            raise ValueError("no vectors to fit on")
        x = _long_form(vectors, "doc_id", "embedding")
        self._d, self._k = d, min(c["n_components"], d)
        self.components, _ = randomized_svd(x, d, self._k, seed=c["random_state"])
        usable = vectors.filter(F.size("embedding") == d)
        reduced = written(self._reduce(usable), "vectors-reduced")
        if c["cell_size"]:
            found = grid_clusters(reduced, c["cell_size"], c["min_points"], "doc_id", "vector")
        else:
            found = density_clusters(
                reduced, c["min_points"], c["min_cluster_size"], "doc_id", "vector", c["neighbours"], seed=c["random_state"]
            )
        rest = vectors.filter(F.coalesce(F.size("embedding"), F.lit(0)) != d).select(F.col("doc_id").alias("id"), F.lit(-1).alias("label"))
        self.labels = written(found.select("id", "label").unionByName(rest), "topic-labels")
        members = written(usable.join(self.labels.withColumnRenamed("id", "doc_id"), "doc_id").filter(F.col("label") != -1), "topic-members")
        self.topic_vectors = written(V.topic_centroids(members, "label", "embedding"), "topic-vectors")
        if c["radius"] is None:
            # the farthest member of any topic from its topic vector
            own = members.join(self.topic_vectors.select("label", "center"), "label")
            self.config["radius"] = float(own.agg(F.max(euclidean("embedding", "center"))).first()[0] or 0.0)
        if docs is not None:
            tf = FE.term_counts(docs.select("doc_id", "text"))
            lab = self.labels.select(F.col("id").alias("doc_id"), "label")
            self.names = written(FE.class_tfidf_names(tf, lab, c["n_name_words"]), "topic-names")
        return self

    def transform(self, vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
        """Reduced vectors (NaN -> 0)."""
        return self._reduce(self._vectors(vectors, id_col, vec_col))

    def predict(self, vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
        """Nearest topic vector if within the model radius, else -1 (also for rows
        without a vector)."""
        v = self._vectors(vectors, id_col, vec_col)
        out = V.predict_within_radius(v, self.topic_vectors, self.config["radius"], "embedding", "euclidean")
        return out.select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"))

    def evaluate(self, vectors: DataFrame, labels: DataFrame | None = None, scores=None, transformed: bool = False) -> DataFrame:
        """One row of cluster scores on the reduced vectors (labels predicted unless
        given as ``doc_id, label``; ``transformed``: ``vectors`` is ``doc_id, vector``)."""
        if transformed and labels is None:
            raise ValueError("reduced vectors need labels")
        reduced = vectors if transformed else self.transform(vectors)
        labels = labels if labels is not None else self.predict(vectors)
        return E.evaluate_clusters(reduced.join(labels.select("doc_id", "label"), "doc_id"), "label", "vector", scores)

    def query_vector(self, spark: SparkSession, query: str | Sequence[float]) -> list[float]:
        """A query's vector: as given, or by the encoder from its text."""
        if not isinstance(query, str):
            return [float(x) for x in query]
        row = self._vectors(spark.createDataFrame([(0, query)], "doc_id long, text string")).first()
        if row is None or row["embedding"] is None:
            raise ValueError("the encoder gave no vector for the query")
        return [float(x) for x in row["embedding"]]

    def similar_topics(self, query: Sequence[float], n: int) -> DataFrame:
        return V.similar_topics(self.topic_vectors, query, n)

    def save(self, path: str, overwrite: bool = False, save_only: Sequence[str] | None = None) -> None:
        """Config (JSON), components with topic vectors, and names; ``save_only``
        limits the parts written (``config``, ``model``, ``names``).  The encoder is
        code and not saved."""
        parts, mode = _saved_parts(save_only), "overwrite" if overwrite else "errorifexists"
        if "config" in parts:
            _write_config(self.topic_vectors.sparkSession, dict(self.config, _d=self._d, _k=self._k), path, mode)
        if "model" in parts:
            self.components.write.mode(mode).parquet(f"{path}/components")
            self.topic_vectors.write.mode(mode).parquet(f"{path}/topic_vectors")
        if "names" in parts and self.names is not None:
            self.names.write.mode(mode).parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: Encoder | None = None) -> "EmbeddingTopicModel":
        from ..sources.files import exists

        cfg = json.loads(spark.read.json(f"{path}/config").first()["config"])
        d, k = cfg.pop("_d"), cfg.pop("_k")
        m = cls(**cfg, encoder=encoder)
        m._d, m._k = d, k
        m.components = spark.read.parquet(f"{path}/components")
        m.topic_vectors = spark.read.parquet(f"{path}/topic_vectors")
        m.names = spark.read.parquet(f"{path}/names") if exists(spark, f"{path}/names") else None
        return m

    def generate_trends(self, query: str | Sequence[float], resolution: str, articles: DataFrame, predictions: DataFrame,
                        closest_n: int = 1, ignore_top_n_dates: int = 0) -> DataFrame:
        """Trend of the ``closest_n`` most similar topics (noise excluded) for a query
        vector, or a text where the model has an encoder."""
        q = self.query_vector(articles.sparkSession, query)
        labels = [int(r["label"]) for r in self.similar_topics(q, closest_n).select("label").collect()]
        return TR.spike_filtered_trend(articles, predictions, resolution, labels, ignore_top_n_dates)


class DocVectorTopicModel:
    """``tokenizer`` names a registered tokenizer (``functions.analyzers``)."""

    def __init__(
        self,
        vector_size: int = 16,
        min_count: int = 2,
        window: int = 5,
        shift: float = 1.0,
        smoothing: float = 0.75,
        n_components: int = 5,
        min_points: int = 10,
        min_cluster_size: int | None = None,
        cell_size: float | None = None,
        n_topic_words: int = 5,
        random_state: int = 0,
        tokenizer: str | None = None,
        combine_kwargs: dict | None = None,
    ):
        self.config = dict(
            vector_size=int(vector_size), min_count=int(min_count), window=int(window), shift=float(shift), smoothing=float(smoothing),
            n_components=int(n_components), min_points=int(min_points), min_cluster_size=min_cluster_size, cell_size=cell_size,
            n_topic_words=int(n_topic_words), random_state=int(random_state), tokenizer=tokenizer, combine_kwargs=dict(combine_kwargs or {}),
        )
        self.clusterer = EmbeddingTopicModel(n_components, min_points, min_cluster_size, None, cell_size, None, 4, random_state, encoder=self.doc_vectors)
        self.words: DataFrame | None = None  # term, v
        self.names: DataFrame | None = None

    @property
    def combine_kwargs(self) -> dict:
        return self.config["combine_kwargs"]

    def doc_vectors(self, docs: DataFrame) -> DataFrame:
        """``doc_id, embedding`` - mean word vector of each document."""
        if self.words is None:
            raise ValueError("model is not fitted")
        return CO.folded(docs.select("doc_id", "text"), self.words, self.config["vector_size"], self.config["tokenizer"])

    def fit(self, docs: DataFrame) -> "DocVectorTopicModel":
        c = self.config
        docs = docs.select("doc_id", "text")
        blocks = CO.token_blocks(docs, c["tokenizer"])
        self.words = CO.word_vectors(
            docs, c["vector_size"], c["window"], c["min_count"], c["shift"], c["smoothing"], c["random_state"], c["tokenizer"], blocks=blocks
        )
        self.clusterer.fit(CO.folded_blocks(blocks, self.words, c["vector_size"]))
        self.names = written(self.topic_words(), "topic-words")
        return self

    @property
    def topic_vectors(self) -> DataFrame:
        return self.clusterer.topic_vectors

    @property
    def labels(self) -> DataFrame | None:
        return self.clusterer.labels

    def topic_words(self) -> DataFrame:
        """``label, name`` - the words nearest to each topic vector, joined by '_'.

        Every vocabulary word is scored against every topic vector, block by block; each
        task passes on its best words per topic, which the skew-safe top-k ranks.
        """
        n = self.config["n_topic_words"]
        return FE.top_terms_name(V.closest_terms(self.words, self.topic_vectors, n), n, "_")

    def predict(self, docs: DataFrame) -> DataFrame:
        return self.clusterer.predict(docs)

    def transform(self, docs: DataFrame) -> DataFrame:
        return self.clusterer.transform(docs)

    def evaluate(self, docs: DataFrame, labels: DataFrame | None = None, scores=None, transformed: bool = False) -> DataFrame:
        return self.clusterer.evaluate(docs, labels, scores, transformed)

    def save(self, path: str, overwrite: bool = False, save_only: Sequence[str] | None = None) -> None:
        """Config, word vectors with the clusterer, and topic words."""
        parts, mode = _saved_parts(save_only), "overwrite" if overwrite else "errorifexists"
        if "config" in parts:
            _write_config(self.words.sparkSession, self.config, path, mode)
        if parts & {"config", "model"}:
            self.clusterer.save(f"{path}/clusterer", overwrite, sorted(parts - {"names"}))
        if "model" in parts:
            self.words.write.mode(mode).parquet(f"{path}/words")
        if "names" in parts:
            self.names.write.mode(mode).parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DocVectorTopicModel":
        from ..sources.files import exists

        m = cls(**json.loads(spark.read.json(f"{path}/config").first()["config"]))
        m.words = spark.read.parquet(f"{path}/words")
        m.clusterer = EmbeddingTopicModel.load(spark, f"{path}/clusterer", encoder=m.doc_vectors)
        m.names = spark.read.parquet(f"{path}/names") if exists(spark, f"{path}/names") else None
        return m

    def query_vector(self, spark: SparkSession, query: str) -> list[float]:
        return self.clusterer.query_vector(spark, query)

    def query_topics(self, spark: SparkSession, query: str, n: int) -> DataFrame:
        return self.clusterer.similar_topics(self.query_vector(spark, query), n)

    def generate_trends(self, query: str, resolution: str, articles: DataFrame, predictions: DataFrame,
                        closest_n: int = 1, ignore_top_n_dates: int = 0) -> DataFrame:
        return self.clusterer.generate_trends(query, resolution, articles, predictions, closest_n, ignore_top_n_dates)
