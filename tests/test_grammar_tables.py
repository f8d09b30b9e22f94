"""Analyses of grammars by joins against those of compiled grammars."""

import pytest

from spangrove.operators.grammar_tables import PRODUCTION, Grammars, productions_of
from spangrove.plans.analysis import conflicts
from spangrove.plans.grammar import compile_grammar
from spangrove.sources.scratch import scratch_save


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


TEXTS = {
    "plain": 'A = B "c" | "d" A . B = C [ "x" ] | ε . C = "c" "e" | A "y" . D = { C } "." | C .',
    "empties": 'S = X Y Z "q" . X = "x" | ε . Y = X X | "y" Z . Z = { X "z" } [ Y ] .',
    "closures": 'word - /[a-z]+/ . S = < "a" | word "," > ( "b" | ε ) { word } . T = S T | .'.replace("| .", '| ε .'),
    "loop": 'S = S | T . T = S "t" | ε .',
}


def test_against_compiled(spark):
    compiled = {k: compile_grammar(t) for k, t in TEXTS.items()}
    rows, traits, starts = productions_of(spark, compiled)
    g = Grammars(rows, ["grammar"], scratch_save(spark), traits)
    held = {
        "first": {tuple(r) for r in g.first.select("grammar", "rule", "token").collect()},
        "follow": {tuple(r) for r in g.follow(starts).select("grammar", "rule", "token").collect()},
        "empty": {tuple(r) for r in g.empty.select("grammar", "rule").collect()},
        "alternative": {tuple(r) for r in g.alternative_first.select("grammar", "alt", "token").collect()},
        "conflict": {tuple(r) for r in g.conflicts(starts).select("grammar", "rule", "kind", "token").collect()},
    }
    want = {k: set() for k in held}
    for k, c in compiled.items():
        named = lambda o: o.name if o.kind == "rule" else f"#{o.number}"
        owners = [*c.rules.values(), *(e for e in c.elements if e.bracket)]
        for r in c.rules.values():
            want["first"] |= {(k, r.name, t) for t in r.first if t}
            want["follow"] |= {(k, r.name, t) for t in r.follow}
            want["empty"] |= {(k, r.name) for t in r.first if not t}
        want["alternative"] |= {(k, str(a.number), t) for o in owners for a in o.alternatives for t in a.first}
        want["conflict"] |= {(k, *x) for x in conflicts(c) if x[0] in c.rules}
        assert all(named(o) for o in owners)
    rules = {(k, r) for k, c in compiled.items() for r in c.rules}
    own = {k: {x for x in v if (x[0], x[1]) in rules} if k != "alternative" else v for k, v in held.items()}
    for k in want:
        assert own[k] == want[k], (k, own[k] - want[k], want[k] - own[k])


def test_reachable_and_odd_rows(spark):
    rows = [(1, "a", "0", 0, "b"), (1, "a", "0", 0, "b"), (1, "b", "0", 0, "x"), (1, "c", "0", 0, "a"), (2, "b", "0", 0, "c"), (None, "a", "0", 0, "b"), (2, None, "0", 0, "b")]
    table = spark.createDataFrame(rows, f"id int, {PRODUCTION}").selectExpr("id", "rule", "alt", "pos", "name", "'z' as token", "1 as node")
    starts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, rule string")
    g = Grammars(table, ["id"], scratch_save(spark))
    assert {tuple(r) for r in g.reachable(starts).collect()} == {(1, "a"), (1, "b"), (2, "b")}
    assert {tuple(r) for r in g.first.collect()} == {(1, "a", "x"), (1, "b", "x"), (1, "c", "x"), (2, "b", "c")}
    assert {tuple(r) for r in g.follow(starts).collect()} == {(1, "a", "○"), (1, "b", "○"), (2, "b", "○")}
    assert g.empty.count() == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], f"id int, {PRODUCTION}")
    g = Grammars(none, ["id"], scratch_save(spark))
    starts = none.select("id", "rule")
    assert [x.count() for x in (g.empty, g.first, g.follow(starts), g.conflicts(starts), g.reachable(starts))] == [0] * 5


def test_chain(spark):
    n = 30
    rows = [(1, f"r{i}", "0", 0, f"r{i + 1}") for i in range(n)] + [(1, f"r{n}", "0", 0, None)] + [(1, f"r{i}", "0", 1, "t") for i in (0, 7)]
    g = Grammars(spark.createDataFrame(rows, f"id int, {PRODUCTION}"), ["id"], scratch_save(spark))
    assert {r.rule for r in g.empty.collect()} == {f"r{i}" for i in range(8, n + 1)}
    assert {tuple(r) for r in g.first.collect()} == {(1, f"r{i}", "t") for i in range(8)}


def test_values(spark):
    """The first of the grammars above, worked out by hand."""
    rows, traits, starts = productions_of(spark, {"": compile_grammar(TEXTS["plain"])})
    g = Grammars(rows, ["grammar"], scratch_save(spark), traits)
    held = lambda df: {(r.rule, r.token) for r in df.collect() if r.rule[0] != "#"}
    assert held(g.first) == {(r, f'"{t}"') for r, ts in (("A", "cd"), ("B", "cd"), ("C", "cd"), ("D", ".cd")) for t in ts}
    assert held(g.follow(starts)) == {("A", "○"), ("A", '"y"'), ("B", '"c"')} | {("C", f'"{t}"') for t in "cdx."}
    assert {r.rule for r in g.reachable(starts).collect() if r.rule[0] != "#"} == {"A", "B", "C"}
