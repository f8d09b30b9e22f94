"""A message beyond most_items has no verdict."""

from spangrove.operators.parse import parse, summary, verdicts


def test_no_verdict(spark):
    df = spark.createDataFrame([("bbb", "accept"), ("c", "reject"), ("b" * 60, "accept")], "text string, want string")
    p = parse(df, 'S = "b" | S S .', keep=(), most_items=500).cache()
    assert {r.want + r.text[:3]: r.v for r in p.selectExpr("want", "text", "parse.accepted v").where("length(text) > 50").collect()} == {"acceptbbb": None}
    assert {(r.expected, r.got, r["count"]) for r in verdicts(p, "want").collect()} == {("accept", "accept", 1), ("reject", "reject", 1), ("accept", "unknown", 1)}
    assert [(r.runs, r.accepted, r.unknown) for r in summary(p).collect()] == [(3, 1, 1)]
