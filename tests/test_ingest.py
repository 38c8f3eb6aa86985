import gzip
import os
import shutil

from .test_sources import FIXTURE


def _gz(src_text: str, path: str):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(src_text)


def test_import_directory_upsert_and_ledger(spark, scratch):
    from topicscope.plans.ingest import CorpusStore, Ledger, import_directory

    data = os.path.join(scratch, "in")
    os.makedirs(data)
    text = open(FIXTURE, encoding="utf-8").read()
    _gz(text, os.path.join(data, "pubmed00n0001.xml.gz"))
    store = CorpusStore(spark, os.path.join(scratch, "corpus"))
    ledger = Ledger(spark, os.path.join(scratch, "ledger"))
    rep = import_directory(spark, data, store, ledger, rejects_path=os.path.join(scratch, "rejects"))
    assert rep["files"] == 1 and rep["rejects"] == 1
    df = store.read()
    # PMID 1001 appears twice in the file: the later record wins
    assert df.count() == 3
    assert df.filter("pmid = 1001").first()["article"]["title"] == "Duplicate identifier, later record"
    # running again imports nothing
    assert import_directory(spark, data, store, ledger)["files"] == 0
    # a second file updating 1002 is picked up; last write wins across loads
    _gz(text.replace("No abstract here", "Updated title"), os.path.join(data, "pubmed00n0002.xml.gz"))
    rep2 = import_directory(spark, data, store, ledger)
    assert rep2["files"] == 1 and rep2["version"] == 1
    df2 = store.read()
    assert df2.count() == 3
    assert df2.filter("pmid = 1002").first()["article"]["title"] == "Updated title"
    assert sorted(r["file_stem"] for r in ledger.read().collect()) == ["pubmed00n0001", "pubmed00n0002"]


def test_ledger_reset_when_target_empty(spark, scratch):
    from topicscope.plans.ingest import CorpusStore, Ledger

    ledger = Ledger(spark, os.path.join(scratch, "ledger"))
    ledger.register(spark.createDataFrame([("a",), ("b",), ("a",)], "file_stem string"))
    ledger.register(spark.createDataFrame([("b",), ("c",)], "file_stem string"))
    assert sorted(r[0] for r in ledger.read().collect()) == ["a", "b", "c"]
    files = spark.createDataFrame([("a", "p/a.xml"), ("d", "p/d.xml")], "file_stem string, path string")
    assert [r["file_stem"] for r in ledger.pending(files).collect()] == ["d"]
    assert ledger.reset_if_target_empty(CorpusStore(spark, os.path.join(scratch, "none")))
    assert ledger.read().count() == 0


def test_import_stream_runs_each_file_once(spark, scratch):
    from topicscope.plans.ingest import CorpusStore
    from topicscope.streaming.ingest import run_import_stream

    data = os.path.join(scratch, "in")
    os.makedirs(data)
    for i in range(3):
        shutil.copy(FIXTURE, os.path.join(data, f"f{i}.xml"))
    store = CorpusStore(spark, os.path.join(scratch, "corpus"))
    ckpt = os.path.join(scratch, "ckpt")
    assert run_import_stream(spark, data, store, ckpt, max_files_per_trigger=2) == 2
    assert store.read().count() == 3
    assert run_import_stream(spark, data, store, ckpt) == 0


def test_bucketed_store_rewrites_only_touched_buckets(spark, scratch):
    from pyspark.sql import functions as F

    from topicscope.plans.ingest import BucketedCorpusStore

    store = BucketedCorpusStore(spark, os.path.join(scratch, "corpus"), bucket_width=10)
    first = spark.createDataFrame([(i, f"a{i}") for i in range(0, 30)], "pmid long, title string")
    assert store.upsert(first) == 3
    before = {r["pmid_bucket"]: r["n"] for r in store.read().groupBy("pmid_bucket").agg(F.count("*").alias("n")).collect()}
    assert before == {0: 10, 1: 10, 2: 10}
    # an update of pmid 5 and a new pmid 35: buckets 0 and 3 only
    upd = spark.createDataFrame([(5, "b5"), (35, "b35")], "pmid long, title string")
    assert store.upsert(upd) == 2
    df = store.read()
    assert df.count() == 31
    assert df.filter("pmid = 5").first()["title"] == "b5"
    assert df.filter("pmid = 15").first()["title"] == "a15"
    assert df.filter("pmid = 15").first()["load_seq"] == 0


def test_import_verifies_checksums(spark, scratch):
    import hashlib

    from topicscope.plans.ingest import CorpusStore, Ledger, import_directory

    data = os.path.join(scratch, "in")
    os.makedirs(data)
    text = open(FIXTURE, encoding="utf-8").read()
    for name, good in (("p0001.xml.gz", True), ("p0002.xml.gz", False)):
        path = os.path.join(data, name)
        _gz(text.replace("1001", "2001") if not good else text, path)
        digest = hashlib.md5(open(path, "rb").read()).hexdigest()
        with open(path + ".md5", "w") as f:
            f.write(f"MD5({name})= {digest if good else 'f' * 32}\n")
    store = CorpusStore(spark, os.path.join(scratch, "corpus"))
    ledger = Ledger(spark, os.path.join(scratch, "ledger"))
    rep = import_directory(spark, data, store, ledger, verify=True, glob="*.gz")
    assert rep["files"] == 1
    assert [os.path.basename(p) for p in rep["quarantined"]] == ["p0002.xml.gz"]
    assert store.read().filter("pmid = 2001").count() == 0
    assert [r["file_stem"] for r in ledger.read().collect()] == ["p0001"]


def test_import_last_n_files(spark, scratch):
    from topicscope.plans.ingest import CorpusStore, Ledger, import_directory

    data = os.path.join(scratch, "in")
    os.makedirs(data)
    text = open(FIXTURE, encoding="utf-8").read()
    _gz(text, os.path.join(data, "p0001.xml.gz"))
    _gz(text.replace("1001", "3001"), os.path.join(data, "p0002.xml.gz"))
    store = CorpusStore(spark, os.path.join(scratch, "corpus"))
    ledger = Ledger(spark, os.path.join(scratch, "ledger"))
    rep = import_directory(spark, data, store, ledger, last_n_files=1)
    assert rep["files"] == 1
    assert [r["file_stem"] for r in ledger.read().collect()] == ["p0002"]
    assert store.read().filter("pmid = 3001").count() == 1


def _record(pmid, title):
    return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><ArticleTitle>{title}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"


def test_the_later_file_wins_and_rejects_are_counted_on_every_path(spark, scratch):
    from topicscope.plans.ingest import BucketedCorpusStore, CorpusStore, Ledger, import_directory
    from topicscope.plans.lifecycle import extract_to_json
    from topicscope.streaming.ingest import run_import_stream

    data = os.path.join(scratch, "in")
    os.makedirs(data)
    # the newer record is in the larger file, which Spark packs first
    many = "".join(_record(i, f"t{i}") for i in range(100, 400))
    with open(os.path.join(data, "f0001.xml"), "w") as f:
        f.write(f"<Set>{_record(1, 'old')}{_record('none', 'reject')}</Set>")
    with open(os.path.join(data, "f0002.xml"), "w") as f:
        f.write(f"<Set>{_record(1, 'new')}{many}{_record('', 'reject')}</Set>")
    title = lambda df: df.filter("pmid = 1").first()["article"]["title"]
    for name, store in (("a", CorpusStore(spark, os.path.join(scratch, "a"))), ("b", BucketedCorpusStore(spark, os.path.join(scratch, "b")))):
        report = import_directory(spark, data, store, Ledger(spark, os.path.join(scratch, "ledger" + name)))
        assert title(store.read()) == "new" and report["rejects"] == 2
    store = CorpusStore(spark, os.path.join(scratch, "c"))
    run_import_stream(spark, data, store, os.path.join(scratch, "ck"))
    assert title(store.read()) == "new" and spark.read.parquet(os.path.join(scratch, "ck_rejects")).count() == 2
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    extract_to_json(spark, data, os.path.join(scratch, "json"), overwrite=True)
    assert spark.read.parquet(os.path.join(scratch, "json_rejects")).count() == 2
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
