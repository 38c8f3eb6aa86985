"""Dictionary (gazetteer) entity extraction.

Every document's tokens are matched against a dictionary of phrases (1 to
``max_len`` tokens, lower case, space separated); matches are chosen left to
right, longest first, without overlap, and the document's entity text is the
chosen phrases joined by a space, in text order, repeats kept.

Matches are found by walking the dictionary as a trie of tokens, one join a level
(``entity_matches``), and the greedy selection is a fold over one document's sorted
matches (``aggregate``), so no document-document or match-match pairs are ever formed.
"""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .common import written


def phrase_key(text: Column | str) -> Column:
    """Normalised phrase: its tokens joined by one space."""
    return F.array_join(tokenize(text), " ")


def dictionary_from_texts(texts: DataFrame, text_col: str = "text", lo: int = 2, hi: int = 3) -> DataFrame:
    """``phrase, n`` - every distinct ``lo..hi``-token phrase of the texts."""
    toks = texts.select(tokenize(text_col).alias("_t"))
    cols = []
    for n in range(int(lo), int(hi) + 1):
        if n == 1:
            cols.append(F.col("_t"))
            continue
        toks = NGram(n=n, inputCol="_t", outputCol=f"_g{n}").transform(toks)
        cols.append(F.col(f"_g{n}"))
    terms = cols[0] if len(cols) == 1 else F.concat(*cols)
    grams = toks.select(F.explode(terms).alias("phrase")).distinct()
    return grams.select("phrase", F.size(F.split("phrase", " ")).alias("n"))


# Largest dictionary level (in phrases) whose prefixes are broadcast; a phrase prefix is
# a short string, so this bounds the broadcast to some hundred megabytes.
MAX_BROADCAST_PREFIXES = 1_000_000


def phrase_trie(dictionary: DataFrame, max_len: int) -> DataFrame:
    """``n, prefix, whole``: every prefix of ``n`` tokens of a dictionary phrase of at
    most ``max_len`` tokens, and whether it is a phrase itself."""
    words = dictionary.select(F.split("phrase", " ").alias("_w")).filter(F.size("_w").between(1, int(max_len)))
    cuts = words.select("_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("n"))
    return cuts.groupBy("n", F.array_join(F.slice("_w", F.lit(1), F.col("n")), " ").alias("prefix")).agg(F.max(F.col("n") == F.size("_w")).alias("whole"))


def entity_matches(docs: DataFrame, dictionary: DataFrame, max_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, n, phrase`` - every dictionary phrase found in a document.

    The dictionary is walked as a trie, one level a join: a position goes on to its
    second token only if some phrase begins with its first, and so on, so the n-grams of
    a text are never made as a whole.  A level is broadcast while it is under
    ``MAX_BROADCAST_PREFIXES``; beyond it the surviving positions are joined by a
    shuffle."""
    max_len = int(max_len)
    trie = written(phrase_trie(dictionary, max_len), "phrase-trie")
    sizes = {r["n"]: r["count"] for r in trie.groupBy("n").count().collect()}  # one row per length
    toks = docs.select(F.col(id_col).alias("doc_id"), tokenize(text_col).alias("_t"))
    # every position with the tokens from there on: the array, and the array moved by one, two ...
    moved = [F.slice("_t", i + 1, F.greatest(F.size("_t") - i, F.lit(0))).alias(f"_{i}") for i in range(max_len)]
    walk = toks.select("doc_id", F.posexplode(F.arrays_zip(*moved)).alias("start", "p")).select("doc_id", "start", "p.*")
    found = None
    for n in range(1, max_len + 1):
        level = trie.filter(F.col("n") == n).select("prefix", "whole")
        level = F.broadcast(level) if sizes.get(n, 0) <= MAX_BROADCAST_PREFIXES else level
        at = walk.filter(F.col(f"_{n - 1}").isNotNull()).withColumn("prefix", F.concat_ws(" ", *[f"_{i}" for i in range(n)])).join(level, "prefix")
        # one write per level: its matches and the positions that go on
        at = written(at.select("doc_id", "start", *walk.columns[2:], "prefix", "whole"), "phrase-walk") if n < max_len else at
        hits = at.filter("whole").select("doc_id", "start", F.lit(n).alias("n"), F.col("prefix").alias("phrase"))
        found = hits if found is None else found.unionByName(hits)
        walk = at.select(*walk.columns)
    return found


def entity_text(docs: DataFrame, dictionary: DataFrame, max_len: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with the entity text of every document ('' if none)."""
    m = entity_matches(docs, dictionary, max_len, id_col, text_col)
    per_doc = m.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", (-F.col("n")).alias("neg_n"), "n", "phrase"))).alias("ms")
    )
    init = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        take = x["start"] >= acc["end"]
        return F.when(
            take,
            F.struct((x["start"] + x["n"]).alias("end"), F.concat(acc["out"], F.array(x["phrase"])).alias("out")),
        ).otherwise(acc)

    chosen = per_doc.select("doc_id", F.array_join(F.aggregate("ms", init, step)["out"], " ").alias("entities"))
    return docs.select(F.col(id_col).alias("doc_id")).join(chosen, "doc_id", "left").select(
        "doc_id", F.coalesce("entities", F.lit("")).alias("text")
    )


def entity_text_with(docs: DataFrame, extractor, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with entities from an external extractor (for example
    an NER pipeline): ``extractor(texts: pandas.Series) -> pandas.Series`` of
    space-joined entity strings, run per Arrow batch with ``mapInPandas`` so
    the model is loaded once per task, not once per row."""

    def run(batches):
        for pdf in batches:
            out = extractor(pdf["text"].fillna(""))
            yield pdf[["doc_id"]].assign(text=list(out))

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, text string")
