"""Suffix dedup against a brute-force scan of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicscope.llm import suffix_dedup
from topicscope.llm.suffix_dedup import _counted, dedup_report, repeated_spans, repeated_windows


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé\x00") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(4, 30))) for _ in range(6)]
    texts = [None, "", "a", "ab" * 200, "a" * 300]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 20)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(5, len(p))], " ".join(word() for _ in range(r.randint(0, 8)))]
        texts.append(" ".join(parts))
    texts += r.sample(texts, 8)
    return texts


@pytest.mark.parametrize("seed,length,gram,cap", [(1, 24, 12, 2000), (2, 40, 20, 3), (3, 15, 4, 2), (4, 64, 40, 5)])
def test_matches_brute_force(spark, seed, length, gram, cap):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    got = {r.doc_id: tuple(r)[1:] for r in dedup_report(docs, length, gram, cap).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeated_rows_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, rid long, spans string"
    rows = [(1, "0123456789" * 50, 1, "a"), (1, "0123456789" * 50, 2, "b"), (None, None, None, None), (None, "x", 1, "c")]
    got = sorted(map(tuple, dedup_report(spark.createDataFrame(rows, schema)).select("n_bytes", "n_removed").collect()))
    assert got == [(0, 0), (1, 0), (500, 500), (500, 500)]
    assert dedup_report(spark.createDataFrame([], schema)).collect() == []


def test_interval_expansion_alone():
    import numpy as np

    ctx = [b"xxABCDEFyy", b"zxABCDEFyz", b"qqABCDEFrr"]
    low, high = repeated_windows(np.zeros(3, int), ctx, np.zeros(3, int), np.full(3, 2), 8)
    assert list(zip(low.tolist(), high.tolist(), strict=True))[:2] == [(1, 1), (1, 1)] and low[2] > high[2]


@pytest.fixture()
def no_small_tables(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_frequent_keys_are_not_dealt_to_one_task(spark, scratch, no_small_tables):
    rows = spark.range(3000).selectExpr("if(id < 2500, -1, id % 250) as key", "id")
    rows.repartition(16).write.parquet(scratch + "/rows")
    rows = spark.read.parquet(scratch + "/rows")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "n").filter("key != 7")
    got = _counted(rows, counts, ["key"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.key, r.n) for r in got) == [(i, -1, 2500) for i in range(2500)] + [(i, i % 250, 2) for i in range(2500, 3000) if i % 250 != 7]
    assert max(Counter(r.task for r in got if r.key == -1).values()) < 1500


def test_copies_of_one_passage_are_not_shuffled(spark, no_small_tables):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(64))
    docs = spark.createDataFrame(enumerate([passage] * 1500 + corpus(5)), "doc_id long, text string")
    spans = repeated_spans(docs, 64, 40)
    assert {r.rid for r in spans.collect()} >= set(range(1500))
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[h#\d+L, c#\d+L\].* Inner", plan)


@pytest.mark.parametrize("seed,length,gram,cap", [(6, 24, 12, 2000), (7, 40, 20, 3)])
def test_frequent_strings_match_brute_force(spark, monkeypatch, seed, length, gram, cap):
    monkeypatch.setattr(suffix_dedup, "FREQUENT_ROWS", 2)
    monkeypatch.setattr(suffix_dedup, "MAX_FREQUENT", 50)
    texts = corpus(seed)
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in dedup_report(docs, length, gram, cap).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_planted_passages_of_over_50_words_go_from_400_bytes_on(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))

    def passage(size, words=55):
        each, more = divmod(size - (words - 1), words)
        return " ".join(text(each + (i < more)) for i in range(words))

    sizes = [300, 399, 400, 401, 700]
    planted = [passage(n) for n in sizes]
    # the letters beside a passage differ, so that no longer string repeats
    texts = [f"{text(900)}{a}{p}{b}{text(900)}" for p in planted for a, b in ("XY", "ZW")] + [text(1900) for _ in range(10)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in dedup_report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)
    assert [got[i][1] for i in range(len(texts))] == [n if n >= 400 else 0 for n in sizes for _ in range(2)] + [0] * 10
