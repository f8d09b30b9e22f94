"""Every query with SQL against that SQL, every other one for rows."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from spangrove import queries, table_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


EVERY, SQL = queries.queries() | table_queries.queries(), queries.ORACLE_SQL | table_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(EVERY))
def test_query(spark, duck, name):
    df = EVERY[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in out.fetchall()]
    assert Counter(got) == Counter(want), (Counter(got) - Counter(want)).most_common(3) + (Counter(want) - Counter(got)).most_common(3)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
