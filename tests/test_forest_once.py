"""Equal texts are parsed once, and what comes of them is not sent by broadcast."""

from spangrove import queries
from spangrove.operators import parse as operator

SF = "/root/testdata/sf0.001"


def test_forests_of_equal_texts_are_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "parse", lambda df, *a, **k: seen.append(df) or operator.parse(df, *a, **k))
    assert queries.forest_tables(spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert seen[0].count() == queries._letters(spark, SF).select("text").distinct().count() < 30


def test_results_of_distinct_texts_are_not_broadcast(spark):
    plan = queries.parse_expressions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
