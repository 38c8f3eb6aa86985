import gzip
import os
import shutil

from pyspark.sql import functions as F

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "medline_sample.xml")


def _articles(spark, path):
    from topicscope.sources.medline import normalise, read_medline_raw

    return normalise(read_medline_raw(spark, path))


def test_medline_parse_fields(spark):
    rows = _articles(spark, FIXTURE).collect()
    first = [r for r in rows if r["pmid"] == 1001 and r["article"]["title"].startswith("Effect")][0]
    a = first["article"]
    assert a["title"] == "Effect of in vitro H2O exposure"
    assert a["abstract"] == "We found p < 0.05 in all groups. Second part."
    assert a["language"] == "eng"
    assert str(a["article_date"]) == "2020-01-01"
    assert str(first["date_completed"]) == "2020-01-02"
    assert str(first["date_revised"]) == "2020-01-03"
    # first keyword list only; an unflagged keyword is minor
    assert first["keywords_major"] == ["cells"]
    assert first["keywords_minor"] == ["water", "unflagged"]
    assert [tuple(x) for x in a["authors"]] == [("Smith", "Jane", ""), ("", "", "Study Group")]


def test_medline_bad_dates_and_missing_parts(spark):
    rows = _articles(spark, FIXTURE).collect()
    by = {}
    for r in rows:
        by.setdefault(r["pmid"], []).append(r)
    r1002 = by[1002][0]
    assert r1002["date_revised"] is None  # month 13
    assert r1002["article"]["article_date"] is None  # missing day
    assert r1002["article"]["abstract"] == ""
    assert r1002["article"]["language"] == "ger"  # first of two
    assert r1002["article"]["authors"] == []
    r1003 = by[1003][0]
    assert r1003["date_completed"] is None  # month "Jan"
    assert r1003["article"] is None
    assert len(by[None]) == 1  # the record without an identifier


def test_rejects_and_gzip(spark, scratch):
    from topicscope.sources.medline import read_medline

    gz = os.path.join(scratch, "pubmed00n0001.xml.gz")
    with open(FIXTURE, "rb") as src, gzip.open(gz, "wb") as dst:
        shutil.copyfileobj(src, dst)
    df = read_medline(spark, gz)
    assert df.filter(F.col("pmid").isNull()).count() == 0
    assert df.count() == 4
    assert {r["file_stem"] for r in df.collect()} == {"pubmed00n0001"}


def test_ndjson_round_trip(spark, scratch):
    from topicscope.sources.medline import read_medline
    from topicscope.sources.ndjson import read_articles_json, write_articles_json

    df = read_medline(spark, FIXTURE)
    out = os.path.join(scratch, "json")
    write_articles_json(df, out)
    # an action line between documents is skipped
    extra = os.path.join(out, "file_stem=x")
    os.makedirs(extra)
    with open(os.path.join(extra, "part-actions.json"), "w") as f:
        f.write('{"index": {"_id": 1}}\n')
    back = read_articles_json(spark, out)
    assert back.count() == df.count()
    assert sorted(r["pmid"] for r in back.collect()) == sorted(r["pmid"] for r in df.collect())


def test_checksums(spark, scratch):
    import hashlib

    from topicscope.sources.listing import verify_checksums

    for name, good in (("a.xml.gz", True), ("b.xml.gz", False)):
        p = os.path.join(scratch, name)
        with open(p, "wb") as f:
            f.write(name.encode() * 10)
        digest = hashlib.md5(open(p, "rb").read()).hexdigest()
        with open(p + ".md5", "w") as f:
            f.write(f"MD5({name})= {digest if good else '0' * 32}\n")
    res = {r["name"]: r["ok"] for r in verify_checksums(spark, scratch).collect()}
    assert res == {"a.xml.gz": True, "b.xml.gz": False}


def test_only_the_asked_files_are_hashed(spark, scratch):
    import hashlib

    from topicscope.sources.checksums import FileChecksums, _Reader, checksums
    from topicscope.sources.listing import list_files, verify_checksums

    bodies = {f"p{i}.gz": bytes([i]) * (1000 * i) for i in range(6)}
    for name, body in bodies.items():
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(body)
        with open(os.path.join(scratch, name + ".md5"), "w") as f:
            f.write(f"MD5({name})= {hashlib.md5(body).hexdigest()}\n")
    os.chmod(os.path.join(scratch, "p0.gz"), 0)
    os.rename(os.path.join(scratch, "p1.gz"), os.path.join(scratch, "p1.gz.part"))  # gone since it was listed
    pending = list_files(spark, scratch).filter("name >= 'p2'")
    got = {r["name"]: (r["ok"], r["actual"]) for r in verify_checksums(spark, scratch, files=pending).collect()}
    assert got == {n: (True, hashlib.md5(b).hexdigest()) for n, b in bodies.items() if n >= "p2"}
    assert checksums(spark, []).collect() == []
    # chunks of any size give the same sum
    path = os.path.join(scratch, "p5.gz")
    for chunk in (1, 7, 1 << 20):
        (part,) = _Reader([path], 8, chunk).partitions()
        assert list(_Reader([path], 8, chunk).read(part)) == [(path, 5000, got["p5.gz"][1])]
    assert len(_Reader([path] * 20, 8, 1).partitions()) == 3 and FileChecksums.name() == "file_checksums"
