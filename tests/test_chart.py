"""The chart as tables against the parse kernel, message by message."""

import pytest

from spangrove.operators import chart as module
from spangrove.operators.chart import chart
from spangrove.operators.lexedges import Terminals, lex_places
from spangrove.plans.grammar import compile_grammar
from spangrove.plans.kernel import Kernel


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)

#: Many small grammars in one, told apart by the first token, so that one chart parses them all.
GRAMMAR = r"""
space : /\s+/ . note : /#[^\n]*/ .
digit - /[0-9]+/ .
due - /[0-9]+\./ . <+<("to")
fee - /[0-9]+\$/ . <-<("to")
@lexicalClass id - /[a-z]+/ .
@splitBefore(">") shut - />+/ .
wide - /[é😀-😂]/ .
S = "①" Sum | "②" Twin | "③" List | "④" Many | "⑤" Empty | "⑥" Loop | "⑦" Gap | "⑧" ("to" | "by") (due | fee) | "⑨" { Free | "stop" "!" }
  | "⑩" Key ( "=" | ":" ) id | "⑪" Lone ( "=" | ":" ) id | "⑫" Close | "⑬" "if" digit | "⑭" Wide .
Sum = Sum "+" Part | Part . Part = "[" Sum "]" | digit .
Twin = "X" | Twin Twin .
List = { id | "," } "!" .
Many = { "A" } < { "B" } | "C" > [ "D" ] .
Empty = Bit [ Tail ] . Bit = ε | "Y" Empty . Tail = { "Z" | Bit } .
Loop = Loop | "P" | Back . Back = Loop .
Gap = digit <s> "K" | digit >s< "M" | digit <n> digit | digit >n< "N" .
Free = id ---("stop") .
Key = id >+>("=") . Lone = id >->("=") .
Close = digit | "<" Close shut .
Wide = wide Wide | wide .
"""
TEXTS = [
    "①1 + 2", " ① 1+[2+3] ", "①1 + + 2", "①", "", "①[[4]]", "①7 #x", "é", "# note\n①1\n#end", "②X", "②XXXX", "②XY", "③a b , c !", "③!", "③, ,", "③a!",
    "④AAB", "④", "④CBD", "④D", "④ABCD", "④AD", "⑤", "⑤Y", "⑤YYZZ", "⑤Z", "⑥P", "⑥PP", "⑦1 K", "⑦1K", "⑦1M", "⑦1 M", "⑦1\n2", "⑦1 2", "⑦3 N", "⑦3\nN", "⑦4\r\n5",
    "⑧to 3.", "⑧by 3.", "⑧to 3$", "⑧by 3$", "⑨go stop", "⑨go stop !", "⑨stopping", "⑨go", "⑩a = b", "⑩a : b", "⑪a = b", "⑪a : b",
    "⑫<<1>>", "⑫<1>", "⑫<<1> >", "⑫<1>>", "⑬if 3", "⑬iff 3", "⑭é😀 😂", "⑭😀 x",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_same_as_kernel(spark, monkeypatch):
    """Verdicts, all spans, all commits and the number of items; and joins of a round move no row."""
    plans = []

    def look(*a, real=module.candidates):
        plans.append(real(*a))
        return plans[-1]

    monkeypatch.setattr(module, "candidates", look)
    g = compile_grammar(GRAMMAR)
    kernel = Kernel(g)
    c = chart(frame(spark, TEXTS), "id", "text", g)
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") > 3 and "hashpartitioning" not in plan
    verdicts = {r.msg: r for r in c.verdicts().collect()}
    names = {i: n for n, i in c.slots.terminals.number.items()}
    spans, commits = {}, {}
    for r in c.spans().collect():
        spans.setdefault(r.msg, set()).add((r.slot, r.i, r.k, r.j))
    for r in c.commits().collect():
        commits.setdefault(r.msg, set()).add((names[r.t], r.at, r.start, r.end, r.after))
    accepted = 0
    for i, text in enumerate(TEXTS):
        p = kernel.parse(text)
        accepted += p.accepted
        assert (verdicts[i].accepted, verdicts[i].exact, verdicts[i].source_len) == (p.accepted, p.exact, len(text)), text
        assert spans.get(i, set()) == {(n, *s) for n, v in p.spans.items() for s in v}, text
        assert commits.get(i, set()) == p.commits, text
        assert verdicts[i]["items"] == p.items, text
    assert 20 < accepted < len(TEXTS) - 15


def test_matches_at_every_place(spark):
    g = compile_grammar(r'space : /\s+/ . @lexicalClass word - /[a-z]+/ . num - /[0-9]+/ . S = word num "if" "+" .')
    texts = ["if iffy 12+", "", "  x", "a😀b", None]
    kernel = Kernel(g)
    names = {i: n for n, i in Terminals(g).number.items()}
    got = {(r.id, r.at): r for r in lex_places(frame(spark, texts), ["id"], "text", Terminals(g)).collect()}
    for i, text in enumerate(texts):
        p = kernel.parse(text or "")
        for at in range(len(text or "") + 1):
            if at and p.lexer.skip(at) != at:
                assert (i, at) not in got
                continue
            want = {(n, *m) for n in names.values() for m in p.lexer.lex(at, n)}
            assert {(names[e.t], e.start, e.end, e.after) for e in got[i, at].edges} == want


def test_null_and_empty_table(spark):
    df = frame(spark, [None, "x"])
    out = {r.msg: r.accepted for r in chart(df, "id", "text", 'T = "x" | "y" T .').verdicts().collect()}
    assert out == {0: False, 1: True}
    assert chart(df.limit(0), "id", "text", 'T = "x" .').verdicts().count() == 0
    with pytest.raises(ValueError):
        chart(df, "id", "text", 'p =| "x" "y" . S = p .')
