"""The registered queries: one DataFrame builder per operator of the inventory.

Every builder takes ``(spark, sf_dir)``, reads the whole parquet tables (or
views Spark derives from them) and returns a DataFrame whose column names
match the DuckDB oracle in ``topicscope.checks.oracle``.  Floating results are
rounded to 6 decimals so that the two engines' summation orders agree.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import assemble_date
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import sampling as S
from ..operators import store as ST
from ..operators import trends as TR
from ..operators import vectors as V
from ..session import shared_dir
from ..sources import listing as LS
from ..sources.tables import articles_view, order_articles, predictions_view, read_table

# Query parameters (the reference's defaults where it has one).
SPIKE_N = 5
TREND_LABELS = (1, 4)
CLOSEST_N = 2
NEAREST_N = 3
TOPK_PER_DOC = 3
SAMPLE_N = 100
SAMPLE_SEED = 42
LAST_N_FILES = 10
MIN_DF = 0.02
MAX_DF = 0.5
RADIUS = 0.95
SUFFIX = "."
# A fixed query vector for the vector-side trend query (rule-generated).
QUERY_VECTOR = tuple(round(math.sin(0.7 * i + 0.3), 6) for i in range(64))

R6 = 6

Builder = Callable[[SparkSession, str], DataFrame]


def _r(c, n=R6):
    return F.round(c, n)


# ---------------------------------------------------------------- dates / trends
def completion_offset(spark, d):
    return TR.completion_offset(order_articles(spark, d))


def reconstruct_date(spark, d):
    return predictions_view(spark, d).select("pmid", "date")


def extract_dates(spark, d):
    a = order_articles(spark, d)
    return a.select(
        "pmid",
        F.to_timestamp_ntz(F.date_format("article_date", "yyyy-MM-dd")).alias("article_ts"),
        F.to_timestamp_ntz(F.date_format("date_completed", "yyyy-MM-dd")).alias("completed_ts"),
        F.to_timestamp_ntz(F.date_format("date_revised", "yyyy-MM-dd")).alias("revised_ts"),
    )


def docs_per_day(spark, d):
    return TR.docs_per_day(order_articles(spark, d), "date_completed")


def docs_per_article_day(spark, d):
    return TR.docs_per_day(order_articles(spark, d), "article_date")


def docs_per_revised_day(spark, d):
    return TR.docs_per_day(order_articles(spark, d), "date_revised")


def rank_days(spark, d):
    return TR.rank_days(TR.docs_per_day(order_articles(spark, d), "date_completed"))


def top_spike_dates(spark, d):
    return TR.top_spike_dates(TR.docs_per_day(order_articles(spark, d), "date_completed"), SPIKE_N)


def drop_spike_dates(spark, d):
    arts = order_articles(spark, d)
    spikes = TR.top_spike_dates(TR.docs_per_day(arts, "date_completed"), SPIKE_N)
    return TR.drop_spike_dates(predictions_view(spark, d), spikes, SPIKE_N)


def _label_trend(res):
    def q(spark, d):
        return TR.label_trend(predictions_view(spark, d), res)

    q.__name__ = f"label_trend_{res}"
    return q


def gap_filled_trend(spark, d):
    return TR.gap_fill(TR.label_trend(predictions_view(spark, d), "month"), "month")


def trend_matrix(spark, d):
    return TR.spike_filtered_trend(order_articles(spark, d), predictions_view(spark, d), "month", TREND_LABELS, SPIKE_N)


def _topic_names(spark, d):
    docs = articles_view(spark, d).select(F.col("pmid").alias("doc_id"), F.col("abstract").alias("text"), "label")
    w = FE.corpus_tfidf(docs, stop_words="english", min_df=MIN_DF, max_df=MAX_DF)
    return FE.cluster_names(FE.cluster_term_weights(w, docs), 3, ", ")


def trend_matrix_wide(spark, d):
    from .trends import pivot_wide

    return pivot_wide(trend_matrix(spark, d), TREND_LABELS)


def name_trends(spark, d):
    trend = trend_matrix(spark, d)
    return TR.name_trends(trend, _topic_names(spark, d))


def trend_series(spark, d):
    return TR.trend_series(name_trends(spark, d))


def trends_for_query(spark, d):
    from .trends import trends_for_vector

    centres = V.topic_centroids(read_table(spark, d, "embeddings"))
    return trends_for_vector(
        centres,
        QUERY_VECTOR,
        order_articles(spark, d),
        predictions_view(spark, d),
        resolution="month",
        distance="cosine",
        closest_n=CLOSEST_N,
        ignore_top_n_dates=SPIKE_N,
    )


# ---------------------------------------------------------------- scalar functions
def assemble_date_q(spark, d):
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("pmid"),
        assemble_date(
            F.year("o_orderdate").cast("string"),
            F.pmod(F.col("o_custkey"), F.lit(14)).cast("string"),
            F.dayofmonth("o_orderdate").cast("string"),
        ).alias("date"),
    )


def split_flagged_array(spark, d):
    """Keyword arrays built per line item (three flagged keywords per record,
    like one citation's keyword list), split into major and minor texts."""
    li = read_table(spark, d, "lineitem")

    def kw(flag, value):
        return F.struct(flag.alias("flag"), value.alias("value"))

    arr = F.array(
        kw(
            F.when(F.col("l_returnflag") == "R", F.lit("Y"))
            .when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
            .otherwise(F.lit("N")),
            F.col("l_partkey").cast("string"),
        ),
        kw(
            F.when(F.col("l_linestatus") == "O", F.lit("Y")).otherwise(F.lit("N")),
            F.when(F.col("l_quantity") > 25, F.col("l_suppkey").cast("string")),
        ),
        kw(F.lit(None).cast("string"), F.col("l_linenumber").cast("string")),
    )
    major, minor = T.split_flagged(arr)
    return li.select(
        F.col("l_orderkey").alias("pmid"),
        "l_linenumber",
        F.size(major).cast("long").alias("n_major"),
        F.size(minor).cast("long").alias("n_minor"),
        F.array_join(major, " ").alias("major"),
        F.array_join(minor, " ").alias("minor"),
    )


def strip_inline_markup(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", T.strip_inline_markup(F.col("html")).alias("text"))


def combine_text(spark, d):
    a = articles_view(spark, d)
    return a.select(
        "pmid",
        T.combine_text("title", "abstract", "keywords_major", "keywords_minor", True, True, True, True).alias("text"),
        T.combine_text("title", "abstract", "keywords_major", "keywords_minor").alias("text_default"),
    )


# ---------------------------------------------------------------- listing / files
def extract_hrefs(spark, d):
    return LS.hrefs(read_table(spark, d, "pages"))


def filter_sorted_names(spark, d):
    return LS.filter_sorted_names(LS.hrefs(read_table(spark, d, "pages")).select(F.col("href").alias("name")), SUFFIX)


def last_n_files(spark, d):
    names = LS.hrefs(read_table(spark, d, "pages")).select(F.col("href").alias("name"))
    return LS.last_n(LS.filter_sorted_names(names, SUFFIX), LAST_N_FILES)


def file_stem(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", T.file_stem("url").alias("file_stem"))


def content_digest(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.md5(F.col("text")).alias("digest"))


def corpus_counts(spark, d):
    from ..sources.tables import TABLES

    return ST.row_counts({t: read_table(spark, d, t, spread_small=False) for t in TABLES})


def _ledger(spark, d):
    # files already imported: every stem some page links to
    return LS.hrefs(read_table(spark, d, "pages")).select(T.file_stem("href").alias("file_stem"))


def _listed_files(spark, d):
    return read_table(spark, d, "pages").select(T.file_stem("url").alias("file_stem"))


def pending_files(spark, d):
    return ST.pending_files(_listed_files(spark, d), _ledger(spark, d))


def ledger_register(spark, d):
    return ST.ledger_register(_ledger(spark, d), _listed_files(spark, d))


def upsert_latest(spark, d):
    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pmid"), F.lit(0).alias("seq"), F.col("o_orderstatus").alias("value")
    )
    li = read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pmid"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("value")
    )
    return ST.upsert_latest(o, li, key="pmid", seq="seq")


def latest_per_key(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "role")
    return ST.latest_per_key(c, key="conv_id", seq="turn")


def unpredicted_docs(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("pmid"))
    preds = read_table(spark, d, "labels").select(F.col("doc_id").alias("pmid"))
    return ST.unpredicted(docs, preds, key="pmid")


# ---------------------------------------------------------------- sampling
def _doc_ids(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("pmid"))


def scan_position(spark, d):
    return S.scan_positions(_doc_ids(spark, d), "pmid")


def sample_forward(spark, d):
    return S.sample(_doc_ids(spark, d), SAMPLE_N, method="forward", key="pmid")


def sample_backward(spark, d):
    return S.sample(_doc_ids(spark, d), SAMPLE_N, method="backward", key="pmid")


def sample_uniform(spark, d):
    return S.sample(_doc_ids(spark, d), SAMPLE_N, method="uniform", key="pmid", seed=SAMPLE_SEED)


# ---------------------------------------------------------------- text features
def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


def _doc_labels(spark, d):
    return articles_view(spark, d).select(F.col("pmid").alias("doc_id"), "label")


def tokenize(spark, d):
    return FE.tokens(_docs(spark, d))


def stopword_filter(spark, d):
    toks = T.tokenize("text")
    kept = T.remove_stop_words(toks, "english")
    return _docs(spark, d).select(
        "doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_content")
    )


def ngrams(spark, d):
    return FE.term_counts(_docs(spark, d), stop_words="english", ngram_range=(1, 2))


def term_doc_freq(spark, d):
    return FE.doc_freq(FE.term_counts(_docs(spark, d), stop_words="english")).select("term", "df")


def df_pruned_vocab(spark, d):
    docs = _docs(spark, d)
    n = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    v = FE.pruned_vocab(FE.doc_freq(FE.term_counts(docs, stop_words="english")), n, MIN_DF, MAX_DF)
    return v.select("term", "df", _r(F.col("idf")).alias("idf"))


def _tfidf(spark, d):
    return FE.corpus_tfidf(_docs(spark, d), stop_words="english", min_df=MIN_DF, max_df=MAX_DF)


def tfidf(spark, d):
    return _tfidf(spark, d).select("doc_id", "term", _r(F.col("tfidf")).alias("tfidf"))


def cluster_term_weights(spark, d):
    w = FE.cluster_term_weights(_tfidf(spark, d), _doc_labels(spark, d))
    return w.select("label", "term", _r(F.col("weight")).alias("weight"))


def cluster_names(spark, d):
    return FE.cluster_names(FE.cluster_term_weights(_tfidf(spark, d), _doc_labels(spark, d)), 3, ", ")


def topic_names_top5(spark, d):
    w = FE.cluster_term_weights(_tfidf(spark, d), _doc_labels(spark, d))
    return FE.top_terms_name(w, 5, "_")


def class_tfidf_names(spark, d):
    return FE.class_tfidf_names(FE.term_counts(_docs(spark, d)), _doc_labels(spark, d), 4)


# ---------------------------------------------------------------- vectors
def _emb(spark, d):
    return read_table(spark, d, "embeddings")


def _centres(spark, d):
    return V.topic_centroids(_emb(spark, d))


def topic_centroids(spark, d):
    c = _centres(spark, d)
    return c.select("label", "size", F.posexplode("center").alias("dim", "value")).select(
        "label", "size", "dim", _r(F.col("value")).alias("value")
    )


def topic_sizes(spark, d):
    return V.topic_sizes(_emb(spark, d))


def assign_nearest(spark, d):
    out = V.assign_nearest(_emb(spark, d), _centres(spark, d), kind="euclidean")
    return out.select("vec_id", "label", _r(F.col("distance")).alias("distance"))


def center_distances(spark, d):
    out = V.center_distances(_emb(spark, d), _centres(spark, d), kind="euclidean")
    return out.select("vec_id", "label", _r(F.col("distance")).alias("distance"))


def cosine_topk(spark, d):
    out = V.nearest_k_per_doc(_emb(spark, d), _centres(spark, d), TOPK_PER_DOC, kind="cosine")
    return out.select("vec_id", "rank", "label", _r(F.col("distance")).alias("distance"))


def euclidean_topk(spark, d):
    out = V.nearest_k_per_doc(_emb(spark, d), _centres(spark, d), TOPK_PER_DOC, kind="euclidean")
    return out.select("vec_id", "rank", "label", _r(F.col("distance")).alias("distance"))


def nearest_topics(spark, d):
    out = V.nearest_topics(_centres(spark, d), QUERY_VECTOR, NEAREST_N, kind="cosine")
    return out.select("label", _r(F.col("distance")).alias("distance"), "rank")


def nearest_topics_euclidean(spark, d):
    out = V.nearest_topics(_centres(spark, d), QUERY_VECTOR, NEAREST_N, kind="euclidean")
    return out.select("label", _r(F.col("distance")).alias("distance"), "rank")


def similar_topics(spark, d):
    out = V.similar_topics(_centres(spark, d), QUERY_VECTOR, NEAREST_N)
    return out.select("label", _r(F.col("similarity")).alias("similarity"), "rank")


def predict_within_radius(spark, d):
    out = V.predict_within_radius(_emb(spark, d), _centres(spark, d), RADIUS, kind="euclidean")
    return out.select("vec_id", "label")


def calinski_harabasz(spark, d):
    return E.calinski_harabasz(_emb(spark, d)).select(_r(F.col("calinski_harabasz")).alias("calinski_harabasz"))


def davies_bouldin(spark, d):
    return E.davies_bouldin(_emb(spark, d)).select(_r(F.col("davies_bouldin")).alias("davies_bouldin"))


def silhouette(spark, d):
    return E.silhouette(_emb(spark, d)).select(_r(F.col("silhouette")).alias("silhouette"))


def evaluate_clusters(spark, d):
    r = E.evaluate_clusters(_emb(spark, d))
    return r.select(*[_r(F.col(c)).alias(c) for c in r.columns])


# ---------------------------------------------------------------- streaming twin
def event_trend_daily(spark, d):
    from ..streaming.trends import event_trend

    return event_trend(read_table(spark, d, "events"), "day")


def event_trend_month(spark, d):
    from ..streaming.trends import event_trend

    return event_trend(read_table(spark, d, "events"), "month")


def event_trend_hour_filled(spark, d):
    from ..streaming.trends import event_trend

    filled = TR.gap_fill(event_trend(read_table(spark, d, "events"), "hour"), "hour")
    return filled.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


def gap_filled_trend_day(spark, d):
    return TR.gap_fill(TR.label_trend(predictions_view(spark, d), "day"), "day")


# ---------------------------------------------------------------- precompute, on fixed labels
PRECOMPUTE_CAP = 100


class _LabelFromText:
    """Stands in for a fitted model, so that SQL can tell every label."""

    @staticmethod
    def predict(docs):
        return docs.select("doc_id", (F.trim("text").cast("long") % 10).cast("int").alias("label"))


def _text_articles(spark, d):
    a = order_articles(spark, d).drop("label")
    none = F.array().cast("array<string>")
    return a.withColumns({"title": F.lit(""), "abstract": F.col("pmid").cast("string"), "keywords_major": none, "keywords_minor": none})


def _done(arts):
    done = arts.filter("pmid % 3 = 0")
    return done.select("pmid", F.lit(None).cast("date").alias("date"), "date_completed", F.lit(-1).alias("label"))


def precompute_dates(spark, d):
    from .precompute import new_predictions

    arts = _text_articles(spark, d)
    return new_predictions(_LabelFromText, arts, _done(arts))


def precompute_capped_forward(spark, d):
    from .precompute import new_predictions

    arts = _text_articles(spark, d)
    return new_predictions(_LabelFromText, arts, _done(arts), PRECOMPUTE_CAP, "forward")


def precompute_capped_uniform(spark, d):
    from .precompute import new_predictions

    arts = _text_articles(spark, d)
    return new_predictions(_LabelFromText, arts, _done(arts), PRECOMPUTE_CAP, "uniform", SAMPLE_SEED)


def precompute_overwrite(spark, d):
    from .precompute import merged_predictions, new_predictions

    arts = _text_articles(spark, d)
    return merged_predictions(_done(arts), new_predictions(_LabelFromText, arts, None, PRECOMPUTE_CAP, "forward"))


OVERWRITE_BATCH = 40


def precompute_overwrite_batches(spark, d):
    """A capped overwrite in batches into a prediction store, and its merged read."""
    from ..sources.delta_store import PredictionStore
    from .precompute import precompute_predictions

    arts = _text_articles(spark, d)
    name = f"batches_{uuid.uuid4().hex[:12]}_predictions"
    store = PredictionStore(spark, name, f"{shared_dir(spark, 'stores')}/{name}")
    store.append(_done(arts))
    precompute_predictions(spark, _LabelFromText, arts, store, PRECOMPUTE_CAP, "forward", overwrite=True, batch_size=OVERWRITE_BATCH)
    rows = store.read()
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    return rows


def trend_cube_matrix(spark, d):
    """The trend of ``trend_matrix`` from a cube that followed a prediction store
    through three increments, the last of which puts a third of the labels right."""
    from ..sources.delta_store import PredictionStore
    from .trend_cube import TrendCube

    tag = f"cube_{uuid.uuid4().hex[:12]}"
    base = f"{shared_dir(spark, 'stores')}/{tag}"
    preds, store, cube = predictions_view(spark, d), PredictionStore(spark, f"{tag}_predictions", f"{base}/store"), TrendCube(spark, f"{base}/cube")
    cube.add_articles(order_articles(spark, d))
    store.append(preds.filter("pmid % 3 = 0").withColumn("label", (F.col("label") + 1) % 10))
    cube.advance(store)
    store.append(preds.filter("pmid % 3 != 0"))
    cube.advance(store)
    store.upsert(preds.filter("pmid % 3 = 0"))
    cube.advance(store)
    spark.sql(f"DROP VIEW IF EXISTS {store.name}")
    return cube.trend("month", TREND_LABELS, SPIKE_N)


def embedding_precompute(spark, d):
    """Bulk labelling by an embedding model with given topic vectors (the mean vector
    of every label) and radius; articles without a stored vector are noise."""
    from .embedding_topics import EmbeddingTopicModel, stored_vectors
    from .precompute import new_predictions

    emb = _emb(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    model = EmbeddingTopicModel(radius=RADIUS, encoder=stored_vectors(emb))
    model.topic_vectors = _centres(spark, d)
    return new_predictions(model, _text_articles(spark, d))


def upsert_across_files(spark, d):
    from .ingest import keep_latest, record_order

    o = read_table(spark, d, "orders")
    records = o.select(
        F.col("o_custkey").alias("pmid"), F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")).alias("file_stem"),
        F.col("o_orderkey").alias("_pos"), F.lit(0).alias("load_seq"), F.col("o_totalprice").alias("price"),
    )
    return keep_latest(records, "pmid", record_order(records)).select("pmid", "file_stem", "price")


# ---------------------------------------------------------------- topic models
MODEL_PARAMS = dict(stop_words="english", min_df=MIN_DF, max_df=MAX_DF, n_components=20, n_clusters=10, random_state=42)
QUERY_TEXT = "the thesis of the station"
_MODELS: dict = {}


def _model(spark, d):
    """The TF-IDF topic model fitted on the whole ``documents`` table (cached
    per session and data set)."""
    from .topics import TfidfTopicModel

    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = TfidfTopicModel(**MODEL_PARAMS).fit(_docs(spark, d))
    return _MODELS[key]


def _flat_articles(spark, d):
    return articles_view(spark, d).drop("label")


def fit_topics(spark, d):
    m = _model(spark, d)
    sizes = m.train_labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return m.names.join(sizes, "label", "left")


def predict_labels(spark, d):
    return _model(spark, d).predict(_docs(spark, d))


def model_center_distances(spark, d):
    return _model(spark, d).transform(_docs(spark, d))


def precompute_labels(spark, d):
    from .precompute import new_predictions

    return new_predictions(_model(spark, d), _flat_articles(spark, d))


def model_trends(spark, d):
    from .precompute import new_predictions

    m = _model(spark, d)
    arts = _flat_articles(spark, d)
    preds = new_predictions(m, arts)
    return m.generate_trends(QUERY_TEXT, "month", arts, preds, "cosine", CLOSEST_N, SPIKE_N)


def generate_figure(spark, d):
    from .precompute import new_predictions

    m = _model(spark, d)
    arts = _flat_articles(spark, d)
    trend = m.generate_trends(QUERY_TEXT, "month", arts, new_predictions(m, arts), "cosine", CLOSEST_N, SPIKE_N)
    return TR.trend_series(TR.name_trends(trend, m.names))


def model_scores(spark, d):
    r = _model(spark, d).evaluate(_docs(spark, d))
    return r.select(*[_r(F.col(c)).alias(c) for c in r.columns])


def _gazetteer(spark, d):
    from ..operators.entities import dictionary_from_texts

    # phrases of the benchmark passages (which recur inside documents)
    return dictionary_from_texts(read_table(spark, d, "benchmark"), "text", 2, 3)


def entity_text(spark, d):
    from ..operators.entities import entity_text as et

    return et(_docs(spark, d), _gazetteer(spark, d), 3)


def entity_trends(spark, d):
    """Trends of the labels nearest to a text by its dictionary entities: the entity
    text of every document, its TF-IDF, the labels' summed weights, their cosine with
    the query's entities (the first benchmark text), and the labels' trend."""
    from ..operators.entities import entity_text as et

    phrases = _gazetteer(spark, d)
    ents = et(_docs(spark, d), phrases, 3)
    tf = FE.term_counts(ents, stop_words="english")
    n = ents.select(F.count(F.lit(1)).cast("double")).scalar()
    vocab = FE.pruned_vocab(FE.doc_freq(tf), n, 1, 1.0)
    weights = FE.cluster_term_weights(FE.tfidf(tf, vocab), _doc_labels(spark, d))
    first = read_table(spark, d, "benchmark", spread_small=False).orderBy("item_id").limit(1).select(F.col("item_id").alias("doc_id"), "text")
    query = FE.term_counts(et(first, phrases, 3), stop_words="english").join(vocab, "term").select("term", (F.col("tf") * F.col("idf")).alias("weight"))
    labels = [int(r["label"]) for r in FE.nearest_by_terms(weights, query, CLOSEST_N).select("label").collect()]
    return TR.spike_filtered_trend(order_articles(spark, d), predictions_view(spark, d), "month", labels, SPIKE_N)


def _entity_model(spark, d):
    from .topics import EntityTopicModel

    key = (spark.sparkContext.applicationId, d, "entity")
    if key not in _MODELS:
        params = dict(MODEL_PARAMS, min_df=1, max_df=1.0, n_clusters=5)
        _MODELS[key] = EntityTopicModel(dictionary=_gazetteer(spark, d), **params).fit(_docs(spark, d))
    return _MODELS[key]


def entity_topics(spark, d):
    return _entity_model(spark, d).names


def entity_model_trends(spark, d):
    text = read_table(spark, d, "benchmark", spread_small=False).orderBy("item_id").first()["text"]
    return _entity_model(spark, d).generate_trends(text, "month", order_articles(spark, d), predictions_view(spark, d), "cosine", CLOSEST_N, SPIKE_N)


def _embedding_model(spark, d):
    from .embedding_topics import EmbeddingTopicModel, stored_vectors

    key = (spark.sparkContext.applicationId, d, "embedding")
    if key not in _MODELS:
        emb = _emb(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
        model = EmbeddingTopicModel(n_components=2, min_points=5, random_state=42, encoder=stored_vectors(emb))
        _MODELS[key] = model.fit(emb, _docs(spark, d))
    return _MODELS[key]


def density_topics(spark, d):
    return _embedding_model(spark, d).labels


def embedding_topic_names(spark, d):
    return _embedding_model(spark, d).names


def embedding_trends(spark, d):
    m = _embedding_model(spark, d)
    return m.generate_trends(list(QUERY_VECTOR), "month", order_articles(spark, d), predictions_view(spark, d),
                             CLOSEST_N, SPIKE_N)


def _doc_vector_model(spark, d):
    from .embedding_topics import DocVectorTopicModel

    key = (spark.sparkContext.applicationId, d, "docvec")
    if key not in _MODELS:
        _MODELS[key] = DocVectorTopicModel(vector_size=16, min_count=5, n_components=2, min_points=5, random_state=42).fit(_docs(spark, d))
    return _MODELS[key]


def doc_vector_topics(spark, d):
    return _doc_vector_model(spark, d).names


def query_topics(spark, d):
    return _doc_vector_model(spark, d).query_topics(spark, QUERY_TEXT, CLOSEST_N)


def doc_vector_trends(spark, d):
    m = _doc_vector_model(spark, d)
    return m.generate_trends(QUERY_TEXT, "month", order_articles(spark, d), predictions_view(spark, d),
                             CLOSEST_N, SPIKE_N)


# Word vectors from counts.
WORD_WINDOW = 2
WORD_MIN_COUNT = 20
PROJECTION_WIDTH = 3


def _word_weights(spark, d):
    """Terms, and their shifted PPMI by number."""
    from ..operators.cooccurrence import numbered_pairs, numbered_vocabulary, ppmi

    terms = numbered_vocabulary(_docs(spark, d), WORD_MIN_COUNT)
    return terms, ppmi(numbered_pairs(_docs(spark, d), terms, WORD_WINDOW), shift=2.0)


def word_cooccurrence(spark, d):
    from ..operators.cooccurrence import pair_counts

    return pair_counts(_docs(spark, d), WORD_WINDOW, WORD_MIN_COUNT)


def word_ppmi(spark, d):
    from ..operators.cooccurrence import named

    terms, weights = _word_weights(spark, d)
    return named(weights, terms).select("term", "context", _r(F.col("w")).alias("ppmi"))


def ppmi_projection(spark, d):
    """One step of the factorisation on a given matrix: the PPMI matrix times a dense
    one with a row per context, here ``sin(i + 2 j)``."""
    from ..operators.common import written
    from ..operators.cooccurrence import numbered_matrix
    from ..operators.svd import times_matrix

    words, weights = _word_weights(spark, d)
    weights = written(weights, "ppmi")
    terms = S.scan_positions(weights.select("term").distinct(), "term").select("term", F.col("pos").cast("int").alias("idx"))
    terms = written(terms, "terms")
    dense = terms.select("idx", F.array(*[F.sin(F.col("idx") + F.lit(2 * j)) for j in range(PROJECTION_WIDTH)]).alias("v"))
    y = times_matrix(numbered_matrix(weights, terms), dense, spark, terms.count(), PROJECTION_WIDTH)
    named = terms.select(F.col("idx").alias("doc_id"), F.col("term").alias("_n")).join(words.select("term", F.col("idx").alias("_n")), "_n")
    rows = y.join(named, "doc_id").select("term", F.posexplode("y").alias("j", "value"))
    return rows.select("term", F.col("j").cast("long").alias("j"), _r(F.col("value")).alias("value"))


def tokenizer_term_freq(spark, d):
    """Document frequencies under a tokenizer that is named, not built in."""
    return FE.doc_freq(FE.term_counts(_docs(spark, d), tokenizer="whitespace")).select("term", "df", "ttf")


# Model-dependent queries: no exact SQL twin (checked for rows plus pytest
# invariants).
ROWS_ONLY: tuple[str, ...] = (
    "entity_topics",
    "entity_model_trends",
    "density_topics",
    "embedding_topic_names",
    "embedding_trends",
    "doc_vector_topics",
    "query_topics",
    "doc_vector_trends",
    "fit_topics",
    "predict_labels",
    "model_center_distances",
    "precompute_labels",
    "model_trends",
    "generate_figure",
    "model_scores",
)

QUERIES: dict[str, Builder] = {
    # dates and trends
    "completion_offset": completion_offset,
    "reconstruct_date": reconstruct_date,
    "extract_dates": extract_dates,
    "docs_per_day": docs_per_day,
    "docs_per_article_day": docs_per_article_day,
    "docs_per_revised_day": docs_per_revised_day,
    "rank_days": rank_days,
    "top_spike_dates": top_spike_dates,
    "drop_spike_dates": drop_spike_dates,
    **{f"label_trend_{r}": _label_trend(r) for r in ("day", "week", "month", "quarter", "year")},
    "gap_filled_trend": gap_filled_trend,
    "trend_matrix": trend_matrix,
    "trend_matrix_wide": trend_matrix_wide,
    "name_trends": name_trends,
    "trend_series": trend_series,
    "trends_for_query": trends_for_query,
    # scalar functions
    "assemble_date": assemble_date_q,
    "split_flagged_array": split_flagged_array,
    "strip_inline_markup": strip_inline_markup,
    "combine_text": combine_text,
    # listing, files, ledger, store
    "extract_hrefs": extract_hrefs,
    "filter_sorted_names": filter_sorted_names,
    "last_n_files": last_n_files,
    "file_stem": file_stem,
    "content_digest": content_digest,
    "corpus_counts": corpus_counts,
    "pending_files": pending_files,
    "ledger_register": ledger_register,
    "upsert_latest": upsert_latest,
    "latest_per_key": latest_per_key,
    "unpredicted_docs": unpredicted_docs,
    # sampling
    "scan_position": scan_position,
    "sample_forward": sample_forward,
    "sample_backward": sample_backward,
    "sample_uniform": sample_uniform,
    # text features
    "tokenize": tokenize,
    "stopword_filter": stopword_filter,
    "ngrams": ngrams,
    "term_doc_freq": term_doc_freq,
    "df_pruned_vocab": df_pruned_vocab,
    "tfidf": tfidf,
    "cluster_term_weights": cluster_term_weights,
    "cluster_names": cluster_names,
    "topic_names_top5": topic_names_top5,
    "class_tfidf_names": class_tfidf_names,
    # vectors and scores
    "topic_centroids": topic_centroids,
    "topic_sizes": topic_sizes,
    "assign_nearest": assign_nearest,
    "center_distances": center_distances,
    "cosine_topk": cosine_topk,
    "euclidean_topk": euclidean_topk,
    "nearest_topics": nearest_topics,
    "nearest_topics_euclidean": nearest_topics_euclidean,
    "similar_topics": similar_topics,
    "predict_within_radius": predict_within_radius,
    "calinski_harabasz": calinski_harabasz,
    "davies_bouldin": davies_bouldin,
    "silhouette": silhouette,
    "evaluate_clusters": evaluate_clusters,
    # streaming trend, batch twin
    "event_trend_daily": event_trend_daily,
    "event_trend_month": event_trend_month,
    "event_trend_hour_filled": event_trend_hour_filled,
    "gap_filled_trend_day": gap_filled_trend_day,
    # precompute and import, on fixed labels and records
    "precompute_dates": precompute_dates,
    "precompute_capped_forward": precompute_capped_forward,
    "precompute_capped_uniform": precompute_capped_uniform,
    "precompute_overwrite": precompute_overwrite,
    "precompute_overwrite_batches": precompute_overwrite_batches,
    "embedding_precompute": embedding_precompute,
    "trend_cube_matrix": trend_cube_matrix,
    "upsert_across_files": upsert_across_files,
    # gazetteer entities (SQL twin: a recursive walk)
    "entity_text": entity_text,
    "entity_trends": entity_trends,
    # word vectors from counts, and a named tokenizer
    "word_cooccurrence": word_cooccurrence,
    "word_ppmi": word_ppmi,
    "ppmi_projection": ppmi_projection,
    "tokenizer_term_freq": tokenizer_term_freq,
    # topic model (rows-only)
    **{name: globals()[name] for name in ROWS_ONLY},
}
