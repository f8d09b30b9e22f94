"""Queries that must take every row."""

import duckdb
from pyspark.sql import functions as F

from spangrove import queries

SF = "/root/testdata/sf0.001"


def texts(spark):
    return queries._expressions(spark, SF).select("text").distinct()


def test_rejected_expressions(spark):
    every = queries.queries()
    bad = texts(spark).where("text like '%+ * %'").count()
    assert bad
    for name in ("token_commits", "parse_ambiguous"):
        out = every[name](spark, SF).cache()
        assert out.where("text like '%+ * %'").count() == bad, name
        assert out.count() == texts(spark).count(), name
    assert {r.tokens for r in every["token_commits"](spark, SF).where("text like '%+ * %'").select("tokens").distinct().collect()} == {1}


def test_residual_ambiguity_parses_all(spark, monkeypatch):
    seen, real = [], queries.parse
    monkeypatch.setattr(queries, "parse", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    n = queries.residual_ambiguity(spark, SF).agg(F.sum("count")).first()[0]
    assert seen == [texts(spark).count()] and n == 2 * texts(spark).where("text not like '%+ * %'").count()


def test_positions_after_200_characters(spark, tmp_path):
    texts = ["a\n" * 300 + "b\tc", "x" * 250 + "\r\ny\t\tz", "\r" * 401, "\r\n" * 201, "é" * 199 + "\t" * 3 + "q", "", "ab"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.quarter): (r.position, r.column_at) for r in queries.queries()["text_positions"](spark, str(tmp_path)).collect()}
    assert [got[i, 4] for i in range(7)] == [("L300P3", 9), ("L1P4", 17), ("L401P0", 0), ("L201P0", 0), ("L0P203", 217), ("L0P0", 0), ("L0P2", 2)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, quarter, position, column_at FROM ({queries.ORACLE_SQL['text_positions']})").fetchall()
    assert got == {(a, b): (c, d) for a, b, c, d in want} and len(got) == 28


def test_join_has_all_rows(spark):
    assert queries.queries()["fts_three_way_join"](spark, SF).count() > 20
