"""Language ID: held-out accuracy of the text model and the fusion by hand."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from topicscope.llm import _bytes as B
from topicscope.llm import language_id as L

from ..conftest import SF_MID


def test_held_out_accuracy_of_the_text_model(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = L.train_text(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1 and length(text) > 40").collect()
    buf, off = B.text_buffer(pa.array([r.text for r in rows]))
    said = model.scores(buf, off).argmax(axis=1)
    right = np.mean([model.languages[i] == r.lang for i, r in zip(said, rows, strict=True)])
    assert right > 0.95


def by_hand(rows, model):
    buf, off = B.text_buffer(pa.array([r.text for r in rows]))
    s = model.scores(buf, off)
    z = s + model.log_prior
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    mass, a = p.sum(axis=0), L.STRENGTH
    share = (mass + 1) / (mass.sum() + len(mass))
    total = lambda f, v: sum(p[j] for j, r in enumerate(rows) if getattr(r, f) == v)
    out = {}
    for i, r in enumerate(rows):
        host, domain = total("host", r.host) - p[i], total("domain", r.domain) - p[i]
        prior = (domain + a * share) / (domain.sum() + a)
        prior = (host + a * prior) / (host.sum() + a)
        post = s[i] - z[i].max() + np.log(prior)
        for f in ("declared", "suffix"):
            kinds = len({getattr(x, f) for x in rows})
            post = post + np.log((np.maximum(total(f, getattr(r, f)) - p[i], 0) + a / kinds) / (mass - p[i] + a))
        out[r.page_id] = (model.languages[int(post.argmax())], 1 / np.exp(post - post.max()).sum())
    return out


def test_fusion_matches_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = L.train_text(docs)
    odd = spark.createDataFrame([(900, None, None), (901, "not a url", "<html>"), (902, "http://x.de/", '<HTML class=a LANG="DE"><body>und der</body>')], "page_id long, url string, html string")
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet").limit(60).unionByName(odd).withColumn("host", F.lit("clash"))
    want = by_hand(L.page_facts(pages).collect(), model)
    got = L.identify(pages, model).collect()
    assert len(got) == 63
    for r in got:
        assert r.lang == want[r.page_id][0] and math.isclose(r.confidence, want[r.page_id][1], rel_tol=1e-6)
    assert next(r for r in got if r.page_id == 902).declared == "de"


def test_empty(spark):
    pages, docs = spark.createDataFrame([(1, "http://a.b", "x")], "page_id long, url string, html string"), spark.createDataFrame([], "doc_id long, text string, lang string")
    assert [r.lang for r in L.language_report(pages, docs).collect()] == [None]
    known = spark.createDataFrame([(1, "abc def", "en")], "doc_id long, text string, lang string")
    assert L.language_report(pages.limit(0), known).collect() == []
