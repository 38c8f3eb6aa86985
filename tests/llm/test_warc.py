"""WARC round trip, revisits and look-ups through the two-level index."""

import hashlib

from pyspark.sql import functions as F

from topicscope.llm import warc


def test_surt():
    assert warc.surt("http://www.A.com:80/x?q=1#f") == "com,a,www)/x?q=1"
    assert warc.surt("https://a.b:8443") == "b,a:8443)/"
    assert warc.surt(None) == ")/"


def test_round_trip_and_lookup(spark):
    big, small = "é" * 700, "s" * 20
    rows = [(i, f"http://h{i % 5}.example.com/p/{i % 40}", [big, small, f"page {i} " * 150, None][i % 4], "x") for i in range(200)]
    rows += [(None, None, big, "x"), (500, "not a url\n", "tail\r\n\r\nend", "x"), (501, "http://[bad", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    root = warc.new_root(spark)
    index = warc.capture(pages, root, file_bytes=4000, block=7)
    records = warc.read_archives(index, root)
    got = {r.page_id: r for r in warc.resolved(records).collect()}
    last = max(i for i in range(200) if i % 4 == 0)
    for i, _, html, _ in rows:
        r, body = got[i], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.payload) == (len(body), hashlib.sha1(body).hexdigest(), html or "")
        again = html == big and i is not None and i != last
        assert (r.record_type, r.refers_to) == (("revisit", last) if again else ("response", None))
    assert len(got) == len(rows)
    urls = spark.createDataFrame([("http://h2.example.com/p/2",), ("http://h2.example.com/none",), ("not a url\n",)], "url string")
    found = warc.lookup(index, urls, root).groupBy("url").agg(F.sort_array(F.collect_list("page_id")).alias("ids")).collect()
    assert {r.url: r.ids for r in found} == {"http://h2.example.com/p/2": [2, 42, 82, 122, 162], "not a url\n": [500]}


def test_empty(spark):
    assert warc.warc_report(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
