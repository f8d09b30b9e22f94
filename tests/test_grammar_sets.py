"""Small grammars in batches against the same grammars by joins."""

import random

import pytest
from pyspark.sql import functions as F

from spangrove import table_queries
from spangrove.operators import grammar_sets
from spangrove.operators.grammar_tables import PRODUCTION, Grammars, productions_of
from spangrove.plans.grammar import compile_grammar
from spangrove.sources.scratch import scratch_save

from test_grammar_tables import TEXTS, few_partitions  # noqa: F401


def made(spark, n=40):
    draw, rows, starts = random.Random(7), [], []
    for g in range(n):
        for r in range(draw.randint(1, 6)):
            for a in range(draw.randint(1, 3)):
                names = [draw.choice([f"r{draw.randint(0, 6)}", f"t{draw.randint(0, 3)}", "○", ""]) for _ in range(draw.randint(0, 4))] or [None]
                rows += [(g, f"r{r}", str(a), 2 * k, x) for k, x in enumerate(names)]
        starts += [(g, f"r{draw.randint(0, 7)}")] * draw.randint(0, 2)
    # more tokens than bits, a long chain, and a start of a grammar that has no rows
    rows += [(n, f"r{k % 2}", str(k), 0, f"t{k}") for k in range(150)] + [(n, "r2", "a", 0, "r0"), (n, "r2", "a", 1, "r1")]
    rows += [(n + 1, f"r{k}", "a", p, x) for k in range(12) for p, x in enumerate([f"r{k + 1}", "t"][: 1 + k % 2])] + [(n + 1, "r12", "a", 0, None)]
    return rows, [*starts, (n, "r2"), (n + 1, "r0"), (n + 2, "r0"), (None, "r0")]


def rows_of(g, starts):
    every = {"first": g.first, "empty": g.empty, "alternative": g.alternative_first, "follow": g.follow(starts), "conflicts": g.conflicts(starts), "reachable": g.reachable(starts)}
    return {k: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str) for k, df in every.items()}


@pytest.mark.parametrize("most", [30])
def test_batches_and_joins(spark, most):
    rows, starts = made(spark, 12)
    table, starts = spark.createDataFrame(rows, f"g long, {PRODUCTION}"), spark.createDataFrame(starts, "g long, rule string")
    batches, joins = (rows_of(Grammars(table, ["g"], scratch_save(spark), most=m), starts) for m in (1 << 10, most))
    for k in batches:
        assert batches[k] == joins[k] and len(set(batches[k])) == len(batches[k]) > 0, k


def test_traits(spark):
    rows, traits, starts = productions_of(spark, {k: compile_grammar(t) for k, t in TEXTS.items()})
    batches, joins = (rows_of(Grammars(rows, ["grammar"], scratch_save(spark), traits, most=m), starts) for m in (1 << 10, 0))
    assert batches == joins


def test_cuts_of_batches(spark, monkeypatch):
    """Grammars stay whole wherever a batch ends."""
    rows = [(g, rule, alt, [name]) for g in range(50) for rule, alt, name in (("a", "0", "b"), ("b", "0", "x"), ("b", "1", f"y{g}"))]
    import pyarrow as pa

    table = pa.table({"g": [r[0] for r in rows], "rule": [r[1] for r in rows], "alt": [r[2] for r in rows], "pos": pa.array([0] * len(rows), pa.int32()), "names": [r[3] for r in rows], "m": [3 * grammar_sets.MARKS] * len(rows)})
    schema = pa.schema([("g", pa.int64()), ("rule", pa.string()), ("token", pa.string())])
    for size in (1, 4, 10, 1000):
        monkeypatch.setattr(grammar_sets, "ROWS", size)
        got = pa.Table.from_batches(grammar_sets.analysed("begin", 1, 10, iter(table.to_batches(7)), schema)).to_pylist()
        assert {(r["g"], r["rule"], r["token"]) for r in got} == {(g, r, t) for g in range(50) for r in "ab" for t in ("x", f"y{g}")} and len(got) == 200


def test_no_round_of_joins(spark, monkeypatch):
    """A table of small grammars takes one write, not one for each round."""
    saved = []
    monkeypatch.setattr(table_queries, "scratch_save", lambda s: lambda df, name: saved.append(name) or scratch_save(s)(df, name))
    for query in (table_queries.first_sets, table_queries.follow_sets, table_queries.ll1_conflicts):
        assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert len(saved) == 3


def test_arrays_of_names(spark):
    rows = [(1, "S", "a", 0, ["T", "u"], True), (1, "T", "b", 0, [], False), (1, "T", "c", 0, None, False), (1, "T", "d", 0, ["v"], False), (2, "S", "a", None, ["x"], True)]
    table = spark.createDataFrame(rows, "g int, rule string, alt string, pos int, name array<string>, top boolean")
    for most in (0, 100):
        g = Grammars(table, ["g"], scratch_save(spark), starting="top", most=most)
        assert {tuple(r) for r in g.first.collect()} == {(1, "S", "u"), (1, "S", "v"), (1, "T", "v")}
        assert [tuple(r) for r in g.empty.collect()] == [(1, "T")]
        assert {tuple(r) for r in g.follow().collect()} == {(1, "S", "○"), (1, "T", "u")}
        assert [r.n for r in g.conflicts().where(F.col("kind") == "alternatives").collect()] == [2]
