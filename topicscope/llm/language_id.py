"""Language of web pages by Bayesian fusion of text, markup, address and host.

* Text: byte trigrams (hashed) under one multinomial per language, counted over
  all labelled documents.  Trigrams overlap, so a text of n trigrams counts as
  ``n / (1 + n / EFFECTIVE)`` independent ones.
* Declared language (``<html lang>``) and address suffix (the host's last
  label): their probabilities given the language, from grouped sums of the text
  posteriors over all pages, smoothed.
* Host prior: the languages seen at the host, smoothed towards its domain, that
  towards all pages; grouped sums again, with the page's own share taken out.

All sums are partial aggregates, and a crowded host is joined as one small row
that Spark can replicate, so no host's pages meet in one task.

A null html is an empty text without markup, a null or odd URL an empty host;
such pages are judged by what is left.  Repeated rows count as pages of their
own.  Documents without text or language teach nothing; without any, the result
has a null language.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

BITS = 14
EFFECTIVE = 60.0
STRENGTH = 5.0
MAX_LANGUAGES = 500


def _trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed trigram) of every trigram inside a document."""
    low = B.ascii_lower(buf).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], code[inside].astype(np.int64)


@dataclass
class TextModel:
    """Log probabilities [language, trigram] and log share of each language."""

    languages: list[str]
    log_p: np.ndarray
    log_prior: np.ndarray

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tempered log likelihood [document, language]."""
        doc, code = _trigrams(buf, off)
        n = np.bincount(doc, minlength=len(off) - 1)
        total = np.stack([np.bincount(doc, weights=p[code], minlength=len(off) - 1) for p in self.log_p], axis=1)
        return total / (1.0 + n / EFFECTIVE)[:, None]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's trigram counts; its memory is bounded by the languages."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
            doc, code = _trigrams(buf, off)
            names, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
            table = np.bincount(which[doc] << BITS | code, minlength=len(names) << BITS).reshape(len(names), -1)
            for k, name in enumerate(names.tolist()):
                counts[name] = counts[name] + table[k] if name in counts else table[k]
                docs[name] = docs.get(name, 0) + int((which == k).sum())
    for name, row in counts.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(row[at], docs[name]))], names=["lang", "code", "n"])


def train_text(docs: DataFrame) -> TextModel:
    """Trigram model from all documents with a text and a language."""
    known = docs.filter("lang is not null and text is not null").select("lang", "text")
    sums = known.mapInArrow(_count_batches, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # at most 2^BITS + 1 rows a language
    rows = sums.collect()
    languages = sorted({r.lang for r in rows})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is meant for at most {MAX_LANGUAGES}")
    table, n = np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages))
    place = {x: i for i, x in enumerate(languages)}
    for r in rows:
        if r.code < 0:
            n[place[r.lang]] = r.n
        else:
            table[place[r.lang], r.code] = r.n
    smooth = table + 0.5
    log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else table
    return TextModel(languages, log_p, np.log((n + 1) / (n.sum() + len(languages))) if languages else n)


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, domain, suffix, declared and visible text of pages."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]{1,10};", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"), F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("declared"), text.alias("text"),
    )


def _score_batches(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in B.doc_chunks(batch.column("text")):
                s = model.scores(buf, off) + model.log_prior
                s -= s.max(axis=1, keepdims=True)
                p = np.exp(s)
                p /= p.sum(axis=1, keepdims=True)
                part = batch.slice(lo, hi - lo)
                arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(model.languages)).cast(pa.list_(pa.float64())) for x in (s - model.log_prior, p)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*part.schema.names[:-1], "s", "p"])

    return run


def _sums(table: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """Per key the summed text posterior of each language, as an array."""
    sums = table.groupBy(by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(name))
    return B.stage(sums, f"lang-{by}")


def _smoothed(own: Column, parent: Column) -> Column:
    """Counts smoothed towards the parent's probabilities."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, parent, lambda n, q: (n + STRENGTH * q) / (total + STRENGTH))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, host, declared, text_lang, lang and its probability."""
    k = len(model.languages)
    facts = page_facts(pages)
    if not k:
        none = F.lit(None).cast("string")
        return facts.select("page_id", "url", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    schema = facts.drop("text").withColumns({"s": F.lit(None).cast("array<double>"), "p": F.lit(None).cast("array<double>")}).schema
    scored = B.stage(facts.mapInArrow(_score_batches(model), schema), "lang-scored")
    whole = scored.agg(*[F.sum(F.col("p")[i]) for i in range(k)], F.countDistinct("declared"), F.countDistinct("suffix")).first()
    mass = [float(x or 0.0) for x in whole[:k]]
    share = [(m + 1.0) / (sum(mass) + k) for m in mass]
    lists = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    out = scored
    for by in ("host", "domain", "declared", "suffix"):
        out = out.join(_sums(scored, by, k, f"n_{by}"), by)
    less = lambda c: F.zip_with(c, "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    prior = _smoothed(less(F.col("n_host")), _smoothed(less(F.col("n_domain")), lists(share)))
    # given the language: how often this value is declared, or this suffix used
    seen = lambda c, kinds: F.zip_with(less(c), F.zip_with(lists(mass), "p", lambda m, p: F.greatest(m - p, F.lit(0.0))), lambda n, m: (n + STRENGTH / kinds) / (m + STRENGTH))
    logs = lambda c: F.transform(c, lambda x: F.log(x))
    evidence = F.array(F.col("s"), logs(prior), logs(seen(F.col("n_declared"), max(1, whole[k]))), logs(seen(F.col("n_suffix"), max(1, whole[k + 1]))))
    log_post = F.aggregate(evidence, lists([0.0] * k), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    names = F.array(*[F.lit(x) for x in model.languages])
    out = out.withColumn("post", log_post)
    best = F.array_max("post")
    return out.select(
        "page_id", "url", "host", "declared", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"), F.element_at(names, F.array_position("post", best).cast("int")).alias("lang"),
        (1.0 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - best))).alias("confidence"),
    )


def language_report(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return identify(pages, train_text(docs)).withColumn("confidence", F.round("confidence", 6))
