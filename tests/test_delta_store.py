"""Delta tables: merged reads against a plain dictionary, and runs that die."""

import json
import random

import pytest
from pyspark.sql import functions as F

from topicscope.sources import files
from topicscope.sources.delta_store import DeltaTable, PredictionStore

SCHEMA = "pmid bigint, value string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], schema)


def content(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return dict(rows)


def test_merged_reads_follow_the_writes(spark, scratch):
    rng = random.Random(2)
    table = DeltaTable(spark, f"{scratch}/t", SCHEMA, fan=3)
    assert not table.exists() and content(table.read()) == {}
    want, history = {}, []
    for step in range(9):
        if step % 3 == 0:
            new = {k: f"a{step}" for k in rng.sample(range(1000 * step, 1000 * step + 50), rng.randrange(1, 30))}
            table.append(frame(spark, new))
        else:
            new = {k: f"u{step}" for k in rng.sample(sorted(want), len(want) // 3)} | {10**6 + step: "new"}
            table.upsert(frame(spark, new))
        want |= new
        history.append((table.versions()[-1], dict(want)))
        assert content(table.read()) == want
    assert content(table.read(history[3][0])) == history[3][1]  # older versions can still be read
    assert len(table.manifest()["parts"]) < 9  # parts were merged on the way
    table.compact()
    assert content(table.read()) == want and len(table.manifest()["parts"]) == 1
    assert table.vacuum() and table.vacuum() == [] and content(table.read()) == want
    table.replace(frame(spark, {1: "x"}))
    assert content(table.read()) == {1: "x"}


def test_a_write_costs_its_rows(spark, scratch):
    table = DeltaTable(spark, f"{scratch}/t", SCHEMA)
    table.append(spark.range(5000).select(F.col("id").alias("pmid"), F.lit("old").alias("value")))
    for i in range(3):
        table.upsert(frame(spark, {i: f"new{i}"}))
    assert [p["rows"] for p in table.manifest()["parts"]] == [5000, 1, 1, 1]
    assert table.read().filter("value != 'old'").count() == 3 and table.read().count() == 5000


def test_batches_commit_once(spark, scratch):
    table = DeltaTable(spark, f"{scratch}/t", SCHEMA)
    assert table.append(frame(spark, {1: "a"}), batch=("s", 0)) == 1
    assert table.append(frame(spark, {1: "a"}), batch=("s", 0)) == 0
    assert table.append(frame(spark, {2: "b"}), batch=("other", 0)) == 1
    assert table.append(frame(spark, {}), batch=("s", 1)) == 0  # an empty batch is committed as well
    assert table.append(frame(spark, {3: "c"}), batch=("s", 1)) == 0
    assert content(table.read()) == {1: "a", 2: "b"}


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "write_text", "rename", "published"])
@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_dies_loses_nothing(spark, scratch, monkeypatch, step, after):
    name = f"killed_{step}_{after}".lower()
    rows = spark.createDataFrame([(1, 5), (2, 6)], "pmid long, label int").selectExpr("pmid", "date'2020-01-01' AS date", "CAST(NULL AS date) AS date_completed", "label")
    store = PredictionStore(spark, name, f"{scratch}/p")
    store.append(rows)
    new = rows.filter("pmid = 2").withColumn("label", F.lit(7))
    owner = files if hasattr(files, step) else PredictionStore
    real = getattr(owner, step)

    def dies(*a, **k):
        if after:
            real(*a, **k)
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(owner, step, dies)
        with pytest.raises(Killed):
            store.upsert(new)
    labels = lambda df: dict(map(tuple, df.select("pmid", "label").collect()))
    committed = step == "published" or (step == "rename" and after)
    again = PredictionStore(spark, name, f"{scratch}/p")  # the next run opens the table anew
    assert labels(again.read()) == labels(spark.table(name)) == {1: 5, 2: 7 if committed else 6}
    again.upsert(new)
    assert labels(again.read()) == labels(spark.table(name)) == {1: 5, 2: 7}
    again.vacuum()
    assert labels(spark.table(name)) == {1: 5, 2: 7}


def test_two_writers_cannot_make_one_version(spark, scratch):
    a, b = (DeltaTable(spark, f"{scratch}/t", SCHEMA) for _ in range(2))
    a.append(frame(spark, {1: "a"}))
    old = b.manifest()
    a.append(frame(spark, {2: "b"}))
    with pytest.raises(RuntimeError):
        b._commit(old, old["parts"], {})
    assert content(b.read()) == {1: "a", 2: "b"}


def test_view_prunes_labels_and_plain_tables_are_taken_over(spark, scratch):
    from topicscope.operators.store import drop_model_tables, ensure_predictions_table

    ensure_predictions_table(spark, "src_taken_predictions")
    spark.sql("INSERT INTO src_taken_predictions VALUES (1, DATE'2020-01-01', NULL, 3), (2, NULL, NULL, -1)")
    store = PredictionStore(spark, "src_taken_predictions")
    store.upsert(spark.sql("SELECT 2L AS pmid, DATE'2021-01-01' AS date, CAST(NULL AS date) AS date_completed, 3 AS label"))
    assert sorted(r["pmid"] for r in spark.table("src_taken_predictions").filter("label = 3").collect()) == [1, 2]
    plan = spark.table("src_taken_predictions").filter("label = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan
    assert drop_model_tables(spark, "taken") == ["src_taken_predictions"]
    assert not spark.catalog.tableExists("src_taken_predictions") and not store.exists()


def test_stream_batches_are_idempotent_and_stop_between_batches(spark, scratch):
    from topicscope.streaming.labelling import run_labelling_stream

    class Stub:
        @staticmethod
        def predict(docs):
            return docs.select("doc_id", F.lit(1).alias("label"))

    cols = "pmid long, title string, abstract string, keywords_major array<string>, keywords_minor array<string>, article_date date, date_completed date"
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, "t", "a", [], [], None, None) for j in range(4)], cols).coalesce(1).write.parquet(f"{scratch}/in/f{i}")
    corpus = spark.read.schema(cols).option("recursiveFileLookup", "true").parquet(f"{scratch}/in")
    stream = lambda: spark.readStream.schema(cols).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    from topicscope.operators.store import drop_table

    drop_table(spark, "stream_stop_predictions")
    calls = []
    n = run_labelling_stream(spark, stream(), Stub, "stream_stop_predictions", f"{scratch}/ck", corpus, stop=lambda: calls.append(1) or len(calls) > 1)
    assert n == 4 and spark.table("stream_stop_predictions").count() == 4
    # as if the run had died between the commit and the checkpoint: the batch comes again
    store = PredictionStore(spark, "stream_stop_predictions")
    assert store.append(store.read(), batch=(f"{scratch}/ck", 0)) == 0
    assert run_labelling_stream(spark, stream(), Stub, "stream_stop_predictions", f"{scratch}/ck", corpus) == 8
    assert run_labelling_stream(spark, stream(), Stub, "stream_stop_predictions", f"{scratch}/ck", corpus) == 0
    assert spark.table("stream_stop_predictions").select("pmid").distinct().count() == spark.table("stream_stop_predictions").count() == 12
    assert json.loads(files.read_text(spark, f"{store.path}/commits/{store.versions()[-1]:010d}.json"))["batches"]
