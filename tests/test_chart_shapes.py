"""Texts of one shape share a chart."""

from pyspark.sql import functions as F

from spangrove import table_queries
from spangrove.operators import chart as operator
from spangrove.operators.lexedges import Terminals
from spangrove.plans.grammar import compile_grammar
from spangrove.queries import ARITHMETIC

SF = "/root/testdata/sf0.001"


def test_shapes(spark):
    texts = ["12 + 3", "1 +  456", "1 + 2 ", "1 * 2", "1 + + 2", "1 +", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", operator.shape(F.col("text"), Terminals(compile_grammar(ARITHMETIC))).alias("x")).select("text", "x.*").collect()
    at = {r.text: list(r.places) for r in rows}
    assert at["12 + 3"] != at["1 +  456"] and at["12 + 3"][0] == 0 and at["12 + 3"][-1] == 6
    # 12 has a second start within the number, which is a place of its own
    assert len({r.shape for r in rows}) == len(texts)
    same = spark.createDataFrame([("12 + 3",), ("45  +\t6",), ("70 + 8",)], "text string").select(operator.shape(F.col("text"), Terminals(compile_grammar(ARITHMETIC))).alias("x"))
    assert same.select("x.shape").distinct().count() == 1 and [r.places for r in same.select("x.places").collect()][1][-1] == 7


def test_few_charts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(table_queries, "chart", lambda df, *a: seen.append(df.count()) or operator.chart(df, *a))
    texts = table_queries.chart_spans(spark, SF).select("text").distinct().count()
    assert 0 < 20 * seen[0] < texts
