"""Queries against their SQL on rows that the test tables do not have."""

from collections import Counter

import duckdb

from spangrove import table_queries


def same(spark, name, folder, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = table_queries.queries()[name](spark, str(folder))
    out = con.execute(table_queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    want, got = Counter(out.fetchall()), Counter(tuple(r[c] for c in names) for r in df.collect())
    assert got == want
    return got


def test_brackets_that_nothing_closes(spark, tmp_path):
    texts = ["(a [b] {", "([)", ")(", '"(" (', "", None]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string")
    documents = spark.createDataFrame([(7, "f(x"), (8, "(]")], "doc_id long, text string")
    got = same(spark, "bracket_pairs", tmp_path, pages=pages, documents=documents)
    assert got["page", 0, 7, None, 2, False] == 1 and got["document", 8, 0, 1, 1, False] == 1
