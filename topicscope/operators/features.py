"""Relational text features: tokens, stop words, n-grams, term and document
frequencies, document-frequency pruning, TF-IDF (smooth idf, L2 norm),
cluster term weights and topic names.

Everything is long form ``(doc_id, term, value)`` so it scales with the number
of non-zeros, not with ``docs x vocabulary``.  The vocabulary is never
collected: it is a DataFrame joined on ``term``; AQE broadcasts it only when
its measured size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzers import tokens_of
from ..functions.text import ngrams, remove_stop_words, stop_word_list, tokenize
from .common import top_k_per_group, written


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, token`` (pos 0-based, in text order)."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.posexplode(tokenize(text_col)).alias("pos", "token")
    )


def analyzed_terms(text: Column | str, stop_words=None, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """The analyzer: tokenize -> drop stop words -> n-grams."""
    return ngrams(remove_stop_words(tokenize(text), stop_words), ngram_range[0], ngram_range[1])


# The texts of a corpus are dealt into up to so many shares, four for each shuffle
# partition: a share's terms are counted in memory by one task.
SHARES = 800


def term_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stop_words=None,
    ngram_range: tuple[int, int] = (1, 1),
    tokenizer: str | None = None,
) -> DataFrame:
    """``doc_id, term, tf`` - raw counts of every analyzed term per document;
    ``tokenizer`` names a registered one (``functions.analyzers``)."""
    lo, hi = ngram_range
    # the texts are dealt by document before they are cut: a document's terms are then
    # counted where they are made, and the (many times larger) terms are not shuffled
    p = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(id_col, text_col).repartition(max(p, min(4 * p, SHARES)), F.col(id_col))
    if (lo, hi) == (1, 1):
        # unigrams: explode first, then drop stop words with a set lookup in a
        # code-generated filter (no per-array lambda)
        exploded = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens_of(text_col, tokenizer)).alias("term"))
        words = stop_word_list(stop_words)
        if words:
            exploded = exploded.filter(~F.col("term").isin(list(words)))
    else:
        # Spark ML's NGram (compiled sliding window) for every n >= 2; the
        # unigrams are the token array itself
        toks = docs.select(
            F.col(id_col).alias("doc_id"), remove_stop_words(tokens_of(text_col, tokenizer), stop_words).alias("_t")
        )
        parts = ["_t"] if lo == 1 else []
        for n in range(max(lo, 2), hi + 1):
            toks = NGram(n=n, inputCol="_t", outputCol=f"_g{n}").transform(toks)
            parts.append(f"_g{n}")
        terms = F.col(parts[0]) if len(parts) == 1 else F.concat(*parts)
        exploded = toks.select("doc_id", F.explode(terms).alias("term"))
    # explicit non-null keys: the later joins would infer these filters on one
    # branch only, and the two uses of ``tf`` would no longer share one shuffle
    exploded = exploded.filter(F.col("doc_id").isNotNull() & F.col("term").isNotNull())
    return exploded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """``term, df, ttf`` - number of documents holding the term and its total
    count over the corpus."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def _df_bound(value: float | int, n_docs: Column) -> Column:
    # int -> absolute document count; float -> proportion of the corpus
    if isinstance(value, bool):
        raise TypeError("min_df / max_df must be int or float")
    if isinstance(value, int):
        return F.lit(float(value))
    return F.lit(float(value)) * n_docs


def pruned_vocab(dfreq: DataFrame, n_docs: Column, min_df: float | int = 1, max_df: float | int = 1.0) -> DataFrame:
    """Terms with ``min_df <= df <= max_df`` (floats are proportions of
    ``n_docs``), with their smooth idf ``ln((1 + n) / (1 + df)) + 1``."""
    lo = _df_bound(min_df, n_docs)
    hi = _df_bound(max_df, n_docs)
    keep = (F.col("df") >= lo) & (F.col("df") <= hi)
    if "ttf" in dfreq.columns:
        # ttf >= df holds by construction; reading ttf keeps the per-document
        # counts identical in both uses of tf (here and in the weighting), so
        # Spark runs the tokenizing stage once and reuses its shuffle output
        keep = keep & (F.col("ttf") >= F.col("df"))
    kept = dfreq.filter(keep)
    return kept.withColumn(
        "idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    )


# A proportional ``min_df`` of this and more leaves a broadcast vocabulary: at most the
# mean number of distinct terms of a document, divided by it.
BROADCAST_MIN_DF = 0.005


def tfidf(tf: DataFrame, vocab: DataFrame, small: bool = False) -> DataFrame:
    """``doc_id, term, tfidf`` - tf x idf, L2-normalised per document.

    The per-document norm is a window over one document's terms (bounded by
    the document length, so no skew); ``tf`` is already clustered by document
    after its aggregation, so the window adds no shuffle.  The vocabulary side
    of the join is pruned by ``min_df`` and is broadcast if it is ``small``, else by AQE
    when it is small enough.
    """
    kept = vocab.select("term", "idf")
    w = tf.join(F.broadcast(kept) if small else kept, "term").select(
        "doc_id", "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", (F.col("w") / norm).alias("tfidf"))


def corpus_tfidf(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stop_words=None,
    ngram_range: tuple[int, int] = (1, 1),
    min_df: float | int = 1,
    max_df: float | int = 1.0,
) -> DataFrame:
    """Tokenize -> stop words -> n-grams -> prune -> TF-IDF over a corpus.

    ``tf`` feeds both the document frequencies and the weighting.  Document
    frequency is a partially aggregated ``groupBy(term)`` (a term found in a
    third of all documents still shuffles one row per task); a window by term
    would put all of that term's rows into one task.
    """
    n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    tf = term_counts(docs, id_col, text_col, stop_words, ngram_range)
    vocab = pruned_vocab(doc_freq(tf), n_docs, min_df, max_df)
    return tfidf(tf, vocab, isinstance(min_df, float) and min_df >= BROADCAST_MIN_DF)


def cluster_term_weights(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, term, weight`` - summed TF-IDF of each term over each cluster."""
    return (
        weights.join(labels.select("doc_id", "label"), "doc_id")
        .groupBy("label", "term")
        .agg(F.sum("tfidf").alias("weight"))
    )


def nearest_by_terms(weights: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """``label, similarity``: the ``n`` labels whose term weights ``label, term, weight``
    have the largest cosine with the query's ``term, weight`` (ties by label at 9
    decimals).  Labels without a common term are left out."""
    norms = weights.groupBy("label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    q = query.groupBy("term").agg(F.sum("weight").alias("_q"))
    dots = weights.join(q, "term").groupBy("label").agg(F.sum(F.col("weight") * F.col("_q")).alias("_d"))
    length = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).scalar()
    scored = dots.join(norms, "label").select("label", F.round(F.col("_d") / (F.col("_n") * length), 9).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "label").limit(int(n))


def top_terms(weights: DataFrame, n: int, weight_col: str = "weight") -> DataFrame:
    """``label, term, weight, rank`` - the ``n`` heaviest terms per label
    (ties by term), skew-safe."""
    # weights are ranked at 10 decimals so that sums which differ only in the
    # last bits (summation order) tie and fall back to the term order
    key = F.round(F.col(weight_col), 10)
    return top_k_per_group(weights, ["label"], [key.desc(), F.asc("term")], n, tiebreak_col="term", rank_col="rank")


def join_top_terms(ranked: DataFrame, sep: str, prefix_label: bool = False) -> DataFrame:
    """``label, name`` - ranked terms joined in rank order."""
    grouped = ranked.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    words = F.array_join(F.transform("_t", lambda s: s["term"]), sep)
    name = F.concat(F.col("label").cast("string"), F.lit(sep), words) if prefix_label else words
    return grouped.select("label", name.alias("name"))


def top_terms_name(weights: DataFrame, n: int, sep: str, prefix_label: bool = False,
                   weight_col: str = "weight", salt_buckets: int = 32) -> DataFrame:
    """``label, name`` - the ``n`` heaviest terms of every label joined by
    ``sep`` (ties by term), in two shuffles: a salted per-piece top-``n``
    (window over ``label, hash(term) % salt_buckets``), then one group per
    label holding at most ``n x salt_buckets`` candidates, sorted and cut."""
    key = F.round(F.col(weight_col), 10)
    salted = weights.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(salt_buckets)))
    w1 = Window.partitionBy("label", "_salt").orderBy(key.desc(), F.asc("term"))
    pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
    grouped = pre.groupBy("label").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-key).alias("k"), F.col("term").alias("term")))), 1, n).alias("_t")
    )
    words = F.array_join(F.transform("_t", lambda s: s["term"]), sep)
    name = F.concat(F.col("label").cast("string"), F.lit(sep), words) if prefix_label else words
    return grouped.select("label", name.alias("name"))


def cluster_names(weights: DataFrame, n_terms: int = 3, sep: str = ", ") -> DataFrame:
    """``label, name`` - the ``n_terms`` heaviest cluster terms, joined."""
    return top_terms_name(weights, n_terms, sep)


def class_tfidf(tf: DataFrame, labels: DataFrame) -> DataFrame:
    """Class-based TF-IDF: ``label, term, weight``.

    Each class is the concatenation of its documents: ``tf`` = term count in the
    class, L1-normalised per class; ``idf = ln(1 + A / f)`` with ``A`` the
    whole-number average count of terms per class and ``f`` the term's count
    over all classes.
    """
    per_class = (
        tf.join(labels.select("doc_id", "label"), "doc_id")
        .groupBy("label", "term")
        .agg(F.sum("tf").alias("ctf"))
    )
    per_class = written(per_class, "class-terms")  # read for both totals, and again for the weights
    class_tot = per_class.groupBy("label").agg(F.sum("ctf").alias("_tot"))
    term_tot = per_class.groupBy("term").agg(F.sum("ctf").alias("_f"))
    avg_words = class_tot.select(F.floor(F.avg("_tot")).cast("double")).scalar()
    return (
        per_class.join(class_tot, "label")
        .join(term_tot, "term")
        .select(
            "label",
            "term",
            ((F.col("ctf") / F.col("_tot")) * F.log(F.lit(1.0) + avg_words / F.col("_f"))).alias("weight"),
        )
    )


def class_tfidf_names(tf: DataFrame, labels: DataFrame, n_words: int = 4) -> DataFrame:
    """``label, name`` = ``<label>_w1_w2_w3_w4`` from class-based TF-IDF."""
    return top_terms_name(class_tfidf(tf, labels), n_words, "_", prefix_label=True)
