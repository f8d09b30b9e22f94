"""Runs of matches: written out place by place they are the edges; cut ones are alike for the filters."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spangrove import table_queries
from spangrove.operators import lexedges as le
from spangrove.operators import lexruns as lr
from spangrove.operators.lexruns import Scanner, lex_runs
from spangrove.plans.grammar import compile_grammar
from spangrove.table_queries import PROSE

OVERLAPPING = r"""
blank : /[ \n_]+/ .
tab : "\t" .
@lexicalClass id - /[a-z_]+/ .
hex - /[0-9a-f]+/ .
@splitBefore(">") more - /[>_]+/ .
star - /[*]/ .
S = id | hex | more | star | "in" | "a" .
"""
PATTERNS = r"""
blank : /\s+/ .
number - /[0-9]+(\.[0-9]+)?/ .
S = number | "in" .
"""
TEXTS = ["", None, " ", "the", "the in then, in,the ...", "a...b", "  lead", "trail \t\r ", "x  ,y\n\n z", "in_a a_in >>_> f0_ **\t*", "_a", "éà 𝛆𝛆 the𝛆 ÿ,", "1.5 in 2.", "....", "de de,  de", "in", "in" * 40]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").repartition(3)


def edges(df):
    return sorted(tuple(r) for r in df.select("id", "start", "t", "end", "after", "gap").collect())


@pytest.mark.parametrize("grammar", [PROSE, OVERLAPPING, PATTERNS])
def test_runs_are_the_edges(spark, grammar):
    terminals = le.Terminals(compile_grammar(grammar))
    want = edges(le.lex_edges(frame(spark), ["id"], "text", terminals))
    for cut in (False, True):
        runs = lex_runs(frame(spark), ["id"], "text", terminals, cut, "id" if cut else None)
        one = runs.withColumn("start", F.explode(F.sequence("start", F.expr("start + places - 1"))))
        assert edges(one) == want


def test_cut_runs_go_through_the_filters(spark):
    terminals = le.Terminals(compile_grammar(PROSE))
    n = terminals.number
    small = [n[f'"{x}"'] for x in ("the", "de", "in")]

    def alive(rows):
        x = le.lookbehind(le.with_before(rows, ["id"]), ["id"], terminals)
        x = le.ahead(le.exclude(x, ["id"], {n["word"]: small}), ["id"], {n["word"]: [n["comma"], n["dots"]]}, True)
        return x.where("alive")

    want = edges(alive(le.lex_edges(frame(spark), ["id"], "text", terminals)))
    got = alive(lex_runs(frame(spark), ["id"], "text", terminals, cut=True))
    assert edges(got.withColumn("start", F.explode(F.sequence("start", F.expr("start + places - 1"))))) == want


def test_a_long_run_is_one_row():
    """Before, a run of n characters was read n times."""
    terminals = le.Terminals(compile_grammar(PROSE))
    offsets, (start, places, t, end, after, _) = Scanner(terminals).scan([b"a" * 2_000_000 + b", ", b"b"], False)
    rows = list(zip(start.tolist(), places.tolist(), t.tolist(), end.tolist(), after.tolist(), strict=True))
    n = terminals.number
    assert rows[: offsets[1]] == [(0, 2_000_000, n["word"], 2_000_000, 2_000_000), (2_000_000, 1, n["comma"], 2_000_001, 2_000_002), (2_000_002, 1, 0, 2_000_002, 2_000_002)]
    assert rows[offsets[1] :] == [(0, 1, n["word"], 1, 1), (1, 1, 0, 1, 1)]


BACK = r"""
blank : /[ \n_]+/ .
@lexicalClass id - /[a-z_]+/ .
hex - /[0-9a-f]+/ . <-<(id)
@splitBefore(">") more - /[>_]+/ . <+<(id)
star - /[*]/ .
S = id | hex | more | star | "in" | "a" .
"""


@pytest.mark.parametrize("grammar", [PROSE, OVERLAPPING, BACK, PATTERNS])
def test_filters_on_sets_keep_what_windows_keep(spark, grammar):
    terminals = le.Terminals(compile_grammar(grammar))
    n = terminals.number
    own = [i for i in n.values() if i]
    excluded, wanted = {t: own for t in own[:2]}, {own[0]: own[1:3], own[1]: own[:1]}
    rows = le.with_before(le.lex_edges(frame(spark), ["id"], "text", terminals), ["id"])
    got = lr.lex_sets(frame(spark), ["id"], "text", terminals)
    got = got.withColumn("start", F.explode(F.sequence("start", F.expr("start + places - 1"))))
    chain = [
        (lambda x: le.lookbehind(x, ["id"], terminals), lr.behind(terminals)),
        (lambda x: le.exclude(x, ["id"], excluded), lr.exclude(excluded)),
        (lambda x: le.ahead(x, ["id"], wanted, True), lr.ahead(wanted, True)),
        (lambda x: le.ahead(x, ["id"], wanted, False), lr.ahead(wanted, False)),
    ]
    for by_windows, by_sets in chain:  # each alone, so that none hides what another does
        assert edges(got.where(by_sets)) == edges(by_windows(rows).where("alive"))
    distinct = le.distinct_ends(le.lookbehind(rows, ["id"], terminals), ["id"])
    assert distinct.count() == got.where(lr.behind(terminals)).count()  # there is nothing for it to do


TURNS = [(1, 0, "the cat, a...b, in\nde  ,x"), (2, 0, "ab  "), (2, 0, "abcd,"), (2, 0, "abcd,"), (2, 0, "the"), (2, 1, "the,"), (3, None, "the cat,"), (3, None, "de"), (None, 1, "in, 12.."), (4, 0, None), (4, 0, ", the")]


def test_turns_that_share_ids_are_asked_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = table_queries.filter_chain(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    out = con.execute(table_queries.ORACLE_SQL["filter_chain"])
    names = [d[0] for d in out.description]
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(out.fetchall())


def test_the_filter_chain_sorts_nothing(spark, tmp_path):
    """Before, five windows over all runs, each with a sort of its own; now windows stand only where ids are shared."""
    spark.createDataFrame(TURNS[:1] + TURNS[5:6], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = table_queries.filter_chain(spark, str(tmp_path))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "MapInArrow" in final and "Window" not in final
