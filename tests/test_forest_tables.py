"""Forests as tables against the kernel's forest, and closures against plain walks."""

import random

import pytest

from spangrove.operators import forest_tables as ft
from spangrove.plans.forest import Forest, Trees, disambiguate, prune_unproductive
from spangrove.plans.grammar import compile_grammar
from spangrove.plans.kernel import Kernel
from spangrove.sources.scratch import scratch_save


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)

GRAMMAR = r"""
space : /\s+/ . n - /[0-9]/ .
S = "①" Twin | "②" Sum | "③" Pick | "④" Shut | "⑤" Long .
Twin = "x" | Twin Twin .
@left Sum = Sum "+" Sum | n .
Pick = @prefer Two | One . Two = n n | n . One = n n | n .
Shut = [ @avoid n ] Tail . Tail = n | n n .
Long = Some { "c" } . @longest Some = "c" | Some "c" .
"""
TEXTS = ["①x", "①xxx", "①xxxx", "②1+2", "②1+2+3+4", "②1+", "③12", "③1", "④1 2", "④1", "⑤ccc", "⑤c", "①xy", ""]


@pytest.fixture(scope="module")
def parsed():
    g = compile_grammar(GRAMMAR)
    return g, [Kernel(g).parse(t) for t in TEXTS]


def tables(spark, ps):
    rows = [(m, n, *s) for m, p in enumerate(ps) for n, x in p.spans.items() for s in x]
    return spark.createDataFrame(rows, "msg long, slot int, i int, k int, j int"), spark.createDataFrame([(m, len(p.text)) for m, p in enumerate(ps)], "msg long, n int")


def held(df):
    out = {}
    for r in df.select("msg", "slot", "i", "k", "j").collect():
        out.setdefault(r.msg, set()).add((r.slot, r.i, r.k, r.j))
    return out


def flat(p):
    return {(n, *s) for n, x in p.spans.items() for s in x}


def test_counts_and_trees(spark, parsed):
    g, ps = parsed
    spans, lengths = tables(spark, ps)
    save = scratch_save(spark)
    edges = ft.forest(spans, g, lengths, save)
    roots = ft.roots_of(spans, g, lengths)
    counted = ft.counts(edges, save)
    got = {r.msg: int(r.n) for r in roots.join(counted, ["msg", "node"]).collect()}
    want = {m: len(list(Trees(p).every(500))) for m, p in enumerate(ps) if p.exact}
    assert got == want and max(got.values()) == 5
    rows = {}
    for r in ft.trees(edges, counted, roots, 3, save).collect():
        rows.setdefault((r.msg, r.tree), set()).add((r.path, r.node))
    assert {m: sum(k[0] == m for k in rows) for m in got} == {m: min(3, n) for m, n in got.items()}
    assert len({(m, frozenset(x)) for (m, _), x in rows.items()}) == len(rows)


def test_prune_and_rules(spark, parsed):
    g, _ = parsed
    ps = [Kernel(g).parse(t) for t in TEXTS]
    spans, lengths = tables(spark, ps)
    save = scratch_save(spark)
    got = held(ft.prune(spans, g, lengths, save))
    for m, p in enumerate(ps):
        if p.exact:
            prune_unproductive(p, len(p.text), all_alive=True)
            assert got[m] == flat(p), p.text
        else:
            assert m not in got
    ps = [Kernel(g).parse(t) for t in TEXTS]
    got = held(ft.resolve(spans, g, lengths, scratch_save(spark)))
    for m, p in enumerate(ps):
        disambiguate(p)
        assert got.get(m, set()) == flat(p), p.text


def test_closures_by_doubling(spark):
    rnd = random.Random(3)
    rows = [(1, k, k + 1) for k in range(1000)] + [(2, a, a + rnd.randrange(1, 6)) for a in range(60)] + [(3, 5, 5), (4, 7, 9)]
    rounds = []
    save = scratch_save(spark)
    df = spark.createDataFrame(rows, "msg long, s int, m int")
    got = {(r.msg, r.s, r.m) for r in ft.closure_ends(df, lambda x, name: rounds.append(name) or save(x, name), ["msg"]).where("msg > 1 or s % 250 = 0").collect()}
    want = set()
    for msg in (1, 2, 4):
        on = {}
        for x, a, b in rows:
            if x == msg:
                on.setdefault(a, set()).add(b)
        for s in on:
            todo, seen = [s], set()
            while todo:
                for b in on.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            want |= {(msg, s, b) for b in seen if msg > 1 or s % 250 == 0}
    assert got == want and len(rounds) <= 12


def test_brackets_share_nodes(spark):
    g = compile_grammar('S = { "a" | "b" } [ "b" ] < "c" > .')
    ps = [Kernel(g).parse(t) for t in ("abcc", "c", "bbc")]
    spans, lengths = tables(spark, ps)
    save = scratch_save(spark)
    edges = ft.forest(spans, g, lengths, save)
    got = {r.msg: int(r.n) for r in ft.roots_of(spans, g, lengths).join(ft.counts(edges, save), ["msg", "node"]).collect()}
    assert got == {m: len(list(Trees(p).every(50))) for m, p in enumerate(ps)} == {0: 2, 1: 1, 2: 2}
    assert isinstance(Forest(ps[0]), Forest)
