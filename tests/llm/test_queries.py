"""The registered queries against their DuckDB twins, and the pipeline."""

import duckdb
import pytest

from tools.compare_oracle import digest
from topicscope.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF_SMALL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(df.columns, rows) == digest(cols, want)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P
    from topicscope.llm import _bytes as B
    from topicscope.llm import minhash, secret_scan

    first = docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, f in P.STAGES[:-1]:
        docs = B.stage(f(spark, docs, SF_SMALL), name)
        assert docs.columns == first.columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    assert minhash.near_duplicates(docs, shingle=5).filter("not kept").isEmpty()
    assert secret_scan.secret_report(docs).filter("n_assign + n_access + n_hex > 0").isEmpty()
    last = P.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert len(last) == sizes[4] and all(r.exact for r in last)
