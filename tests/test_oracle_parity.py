"""Every registered query against its DuckDB twin on the smallest data set."""

import pytest

from topicscope.checks.oracle import ORACLE_SQL
from topicscope.plans.registry import QUERIES
from tools.compare_oracle import digest

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from topicscope.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows) == digest(dcols, drows)


def test_every_query_has_an_oracle_or_is_model_dependent():
    missing = set(QUERIES) - set(ORACLE_SQL)
    from topicscope.plans.registry import ROWS_ONLY

    assert missing == set(ROWS_ONLY)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["label", "date", "articles", "name"]
    assert df.count() > 0
