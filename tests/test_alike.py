"""Texts of one form are parsed once."""

from pyspark.sql import functions as F

from spangrove import queries, table_queries
from spangrove.operators import alike, chart, parse
from spangrove.plans.grammar import compile_grammar
from spangrove.queries import ARITHMETIC

SF = "/root/testdata/sf0.001"


def test_characters():
    same = alike.same_characters(compile_grammar(ARITHMETIC))
    assert same["7"] == same["1"] == "0" and same["\t"] == " " and same["z"] == "a" and "0" not in same
    words = alike.same_characters(compile_grammar(table_queries.PROSE))
    assert not set("thedein") & set(words) and words["z"] == "a" and words["\t"] == " "
    split = alike.same_characters(compile_grammar('@splitBefore("5") n - /[0-9]+/ . S = n "7" .'))
    assert "5" not in split and "7" not in split and split["9"] == "0"
    assert not alike.same_characters(compile_grammar('n - /[0-9]+(x|y)/ . S = n .'))


def test_forms_parse_as_texts(spark):
    texts = ["12 + 3", "45\t+ 6", "1 +\n456", "78 * 9 +", "a + 1", "b + 1", "٣ + 1", "", "(1)*2", "(0)*9", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    keep = ("bsr", "commits", "diagnostics")
    whole = {r.text: r.parse for r in parse.parse(df, ARITHMETIC, keep=keep).collect()}
    forms = parse.parse_forms(df, ARITHMETIC, keep=keep)
    assert forms.count() == len({t.translate(str.maketrans("123456789\tb", "000000000 a")) for t in texts if t is not None}) == 7
    for sent in (alike.SENT, -1):
        alike.SENT, before = sent, alike.SENT
        got = {r.text: r.parse for r in alike.with_found(df, compile_grammar(ARITHMETIC), forms).collect()}
        alike.SENT = before
        assert got == whole


def test_queries_parse_few(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(parse, "parse", lambda df, *a, _made=parse.parse, **k: seen.append(df.count()) or _made(df, *a, **k))
    for query in (queries.terminal_texts, queries.residual_ambiguity):
        assert query(spark, SF).count() > 0
    assert len(seen) == 2 and max(seen) < 40


def test_charts_take_forms(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(table_queries, "shape", lambda *a: seen.append(a) or chart.shape(*a))
    monkeypatch.setattr(table_queries, "chart", lambda df, *a: seen.append(df) or chart.chart(df, *a))
    df = table_queries.chart_spans(spark, SF)
    shaped = seen[1].select("text").collect()
    assert 0 < len(shaped) < 40 and all(set(r.text) <= set("0 +*()") for r in shaped)
    assert df.where(F.col("text").rlike("[1-9]")).count() > 0
