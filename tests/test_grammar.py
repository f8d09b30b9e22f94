"""Grammars, the kernel, disambiguation and trees, message by message."""

import itertools

import pytest

from spangrove.plans.analysis import conflicts, is_ll1, overlaps
from spangrove.plans.forest import Trees, choices, disambiguate, sppf, unambiguous
from spangrove.plans.grammar import GrammarError, compile_grammar, ebnf, tokenize
from spangrove.plans.kernel import Kernel, TooLarge
from spangrove.plans.lexing import layout_tokens

SPACE = r"whitespace : /\s+/. "

CASES = [
    ("a row of literals", 'Greeting = "hi" "," "you" "!" .', ["hi,you!", "hi , you !"], ["hi,you", "hi,you!!", ""]),
    ("selection", 'S = "a" | "b" "c" | "".', ["a", "bc", ""], ["b", "abc"]),
    ("optional", 'S = ["x"] "x".', ["x", "xx"], ["", "xxx"]),
    ("one or more of maybe nothing", 'S = < "x" | "" >.', ["x", "xx", ""], ["y"]),
    ("closure", 'S = { ["a"] } "b".', ["b", "aab", "ab"], ["a", ""]),
    ("closures in a row", 'S = { "b" } { "b" } { "b" }.', ["", "b", "bbbbb"], ["a"]),
    ("nested brackets", 'S = ( "a" | [ "b" < "c" > ] ) "d".', ["d", "ad", "bcd", "bccd"], ["bd", "cd"]),
    ("postfix marks", 'S = A*. A = "a" | "b"+ "c"?.', ["", "abbca", "bcbc"], ["c", "ac"]),
    ("left recursion", 'S = "x" | S "x".', ["x", "xxx"], [""]),
    ("right recursion", 'S = "x" S | ε.', ["", "xxx"], ["y"]),
    ("hidden left recursion", 'S = ["y"] S "x" | "x".', ["x", "xxx", "yxx"], ["y", "yy"]),
    ("mutual recursion", 'S = A "a" | "s". A = S "b" | "t".', ["s", "ta", "sba", "taba"], ["tb", "sb"]),
    ("cycle", 'S = A. A = A | "x".', ["x"], ["", "xx"]),
    ("highly ambiguous", 'S = "x" | S S | S S S.', ["x", "xx", "xxxxx"], ["", "y"]),
    ("nullable everywhere", 'S = A B A. A = [ "a" ]. B = { A }.', ["", "a", "aaaa"], ["b"]),
    ("indirection", 'S = A. A = B. B = C "z". C = "c" | ε.', ["cz", "z"], ["c"]),
    ("rules merge", 'S = "a". S = "b".', ["a", "b"], ["ab"]),
    ("alias", 'plus - "+". n - /[0-9]+/. S = n plus n.', ["1+2", "1 + 2"], ["1 2"]),
    ("trivia by a rule", 'aside =: "{" { /[^{}]/ | aside } "}" . Pair = "1" "2".', ["1{x{y}}2", "{}12", "1 2"], ["1{2", "1}2"]),
    ("lexical rule", 'w =| "x" { "y" }. S = w w.', ["xy xyy", "xx"], ["x y x", "x"]),
    ("two terminals on one text", 'low - /[0-4]+/. any - /[0-9]+/. Bound = low "<" | any ">" .', ["3<", "3>", "77 >"], ["77<", "3"]),
    ("not after", r'share - /[0-9]+%/ . <-<("minus") Rate = "minus" share | "plus" share .', ["plus 5%"], ["minus 5%"]),
    ("only after", r'id - /[a-z]+/ . <+<("#") S = "#" id | "!" id.', ["#a"], ["!a"]),
    ("exclusion", 'name - /[a-z]+/. Doc = "begin" { item } "end" . item = name ---("end").', ["begin a b end", "begin end"], ["begin end end", "begin ab"]),
    ("must be followed", 'id - /[a-z]+/. S = id >+>("(") "(" | id "x" "y".', ["a(", "b x y"], ["a"]),
    ("must not be followed", 'id - /[a-z]+/. S = id >->("(") [ "(" ].', ["a"], ["a("]),
    ("longest word hides a literal", '@lexicalClass id - /[a-z]+/. S = "for" id.', ["for x"], ["forx", "foreach x"]),
    ("split before", r'@splitBefore("/") op - /[*\/]+/. rx - /\/[a-z]+\//. S = op rx | op.', ["**/ab/", "**/"], ["/ab/x"]),
    ("space", 'S = "a" <s> "b" | "a" >s< "c".', ["a b", "ac"], ["ab", "a c"]),
    ("line break", 'S = "a" <n> "b" | "a" >n< "c" <n>.', ["a\nb", "a\r\nb", "a c"], ["a b", "a\nc"]),
    ("layout", 'S = "if" ":" >>| < "x" > |<< [ "y" ].', ["if :\n  x\n  x\ny", "if :\n\tx"], ["if :\nx"]),
    ("builder", "v - @builder(digits) . S = v.", ["12"], ["a"]),
    ("scalars beyond 16 bits", 'S = "😀" "é" /[a-z]/.', ["😀éa", "😀 é z"], ["é"]),
    ("empty text", 'S = ε.', ["", " \n"], ["a"]),
]


@pytest.mark.parametrize("label,grammar,good,bad", CASES, ids=[c[0] for c in CASES])
def test_verdicts(label, grammar, good, bad):
    k = Kernel(compile_grammar(SPACE + grammar, {"digits": "[0-9]+"}))
    assert [k.parse(t).accepted for t in good + bad] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize("text", ["S = .", "S = x.", 'S = "a"', "S = @builder(q).", "", 's - "x".', 'S = ( "a" .', "a - /[/. S = a.", 'S = "a" . ---', 'S = "b" >+> "c".', "S = t. t - /x/.", 'x - /x/. <+<("a"), <-<("b") S = x.'])
def test_illegal_grammars(text):
    with pytest.raises(GrammarError):
        compile_grammar(text)


def brute(grammar, text, start="S"):
    """All strings of a grammar in plain form are too many: membership by splitting, for rules as lists of symbols."""
    from functools import cache

    @cache
    def rule(name, i, j, depth):
        return depth > 0 and any(body(tuple(b), i, j, depth) for b in grammar[name])

    @cache
    def body(b, i, j, depth):
        if not b:
            return i == j
        head, rest = b[0], b[1:]
        if head in grammar:
            return any(rule(head, i, k, depth - 1) and body(rest, k, j, depth) for k in range(i, j + 1))
        return text.startswith(head, i) and i + len(head) <= j and body(rest, i + len(head), j, depth)

    return rule(start, 0, len(text), 2 * len(text) + 6)


def test_against_brute_force():
    plain = {"S": [["a", "S", "b"], ["T", "S"], []], "T": [["a"], ["T", "b", "T"], ["b", "a"]]}
    k = Kernel(compile_grammar('S = "a" S "b" | T S | ε. T = "a" | T "b" T | "b" "a".'))
    for n in range(7):
        for t in itertools.product("ab", repeat=n):
            t = "".join(t)
            assert k.parse(t).accepted == brute(plain, t), t


def test_spans_of_doubling():
    g = compile_grammar('S = "b" | S S .')
    p = Kernel(g).parse("b" * 6)
    second = g.root.alternatives[1].elements[1].number
    assert p.spans[second] == {(i, k, j) for i in range(7) for k in range(i + 1, 7) for j in range(k + 1, 7)}
    assert len(Trees(p).every(1000)) == 42 and len(Trees(p).every(5)) == 5
    nodes, edges = sppf(p)
    assert sum(n[1] == "symbol" for n in nodes) == 21 and {e[1] for e in edges} <= {n[0] for n in nodes}


NUMBER = "number - /[0-9]+/ . "


@pytest.mark.parametrize("rule,deep", [("@left", 0), ("@right", 2)])
def test_associativity(rule, deep):
    p = Kernel(compile_grammar(SPACE + NUMBER + f'{rule} E = E "+" E | number .')).parse("1 + 2 + 3")
    assert p.exact and disambiguate(p) > 0 and p.exact and unambiguous(p)
    tree = Trees(p).every()[0]
    assert [len(c.children) for c in tree.children][deep] == 3


@pytest.mark.parametrize("grammar,text", [('S = @prefer A | B. A = "x". B = "x".', "x"), ('mod - /m/. id - /[a-z]+/. S = [ @avoid mod ] id [ id ] .', "mx"), ('S = W { "a" }. @longest W = { "a" }.', "aaa"), ('S = W { "a" }. @shortest W = { "a" }.', "aaa")])
def test_choices_drop_spans_and_keep_the_parse(grammar, text):
    p = Kernel(compile_grammar(grammar)).parse(text)
    before = p.span_count()
    gone = disambiguate(p)
    assert p.exact and gone == before - p.span_count()


def test_longest_and_shortest_extents():
    for rule, end in (("@longest", 3), ("@shortest", 0)):
        g = compile_grammar(f'S = W {{ "a" }}. {rule} W = {{ "a" }}.')
        p = Kernel(g).parse("aaa")
        disambiguate(p)
        assert {j for i, _, j in p.spans[g.rules["W"].number] if i == 0} == {end}


def test_disambiguation_needs_an_exact_root():
    p = Kernel(compile_grammar(SPACE + 'S = "x".')).parse("x y")
    assert not p.exact and disambiguate(p) == 0


def test_rules_come_in_a_fixed_order():
    g = compile_grammar('@left E = E E | "x". @longest L = @prefer E | "x". S = L [ @avoid "y" ] E.')
    assert [c.kind for c in choices(g)] == ["longest", "left", "left", "left", "prefer", "avoid"]


def test_diagnostics():
    t = Trees(Kernel(compile_grammar('S = A | B. A = "x". B = "x".')).parse("x"))
    t.one()
    assert [(d.node, d.message, d.candidates, d.signature) for d in t.diagnostics] == [("S", "ambiguous alternate", 2, "[A] | [B]")]
    t = Trees(Kernel(compile_grammar('S = A A. A = { "x" }.')).parse("xx"))
    t.one()
    assert t.diagnostics[0].message == "ambiguous pivot" and t.diagnostics[0].signature == "body=[A A]" and t.diagnostics[0].candidates == 3
    t = Trees(Kernel(compile_grammar('S = { A }. A = "x" | "x" "x".')).parse("xx"))
    t.one()
    assert t.diagnostics[0].message == "ambiguous iteration extent"


def test_trees_guard_cycles():
    p = Kernel(compile_grammar('S = A. A = A | "x".')).parse("x")
    assert len(Trees(p).every()) == 1 and Trees(p).one().dump().endswith("!")


def test_images_and_furthest_mismatch():
    g = compile_grammar(SPACE + 'id - /[a-z]+/. n - /[0-9]+/. S = "let" id "=" n ";" .')
    p = Kernel(g).parse("let x = ?")
    # What follows a token is tried with it, so the mismatch is at the token before.
    assert not p.accepted and p.furthest == 6 and p.expected == {'"="'}
    q = Kernel(g).parse(" let  x = 1;")
    assert [c.image for c in Trees(q).one().children] == [" let", "x", "=", "1", ";"]


@pytest.mark.parametrize("grammar,yes", [('S = "a" | "b".', True), ('S = "a" "b" | "a" "c".', False), ('S = [ "a" ] "a".', False), ('S = { "a" } "b".', True), ('S = A "a". A = ["a"].', False), ('S = S "a" | "b".', False), ('S = "a" S | ε.', True), ('S = A | B. A = ε. B = ε.', False), ('S = A "x" | "y". A = "z" | ε.', True)])
def test_ll1(grammar, yes):
    assert is_ll1(compile_grammar(grammar)) == yes


def test_overlaps():
    g = compile_grammar('id - /[a-z]+/. S = "x" | "xx" | id | "9".')
    assert {(a, b) for _, a, b in overlaps(g)} == {('"x"', '"xx"'), ('"x"', "id"), ('"xx"', "id")}
    assert conflicts(g) == []


def test_first_follow_and_exclusion():
    g = compile_grammar('id - /[a-z]+/. S = N { "," N } [ ";" ]. N = id ---("if" "do") | "(" S ")". "if" - "if".'.removesuffix(' "if" - "if".'))
    n = g.rules["N"]
    assert n.first == {"id", '"("'} and n.follow == {'","', '";"', '")"', "○"}
    assert g.rules["S"].exclude == {'"if"', '"do"'} and n.exclude == {'"if"', '"do"'}
    assert "S = N" in ebnf(g)


def test_layout_tokens():
    text = "a:\n  b\n  c:\n      d\n    e\nf\n# x\n\n  ( g\nh )\n"
    got = layout_tokens(text)
    assert [(text[i], "".join(">" if t == ">>|" else "<" for t in x)) for i, x in sorted(got.items()) if i < len(text)] == [("b", ">"), ("d", ">"), ("e", "<"), ("f", "<"), ("(", ">")]
    assert got[len(text)] == ["|<<"]
    assert layout_tokens("a:\r\n\tb\r\nc") == {5: [">>|"], 8: ["|<<"]}


def test_messages_actions_and_limits():
    g = compile_grammar("'pre' S 'sig' = \"x\" 'act' . 'post' ^^^ one\n^^^two")
    assert (g.preamble, g.epilogue, g.rules["S"].signature, g.messages) == (["pre"], ["post"], "sig", [" one\n", "two"])
    assert [t.kind for t in tokenize("a // c\n /* b */ = /x/ .")] == ["name", "=", "regex", ".", "end"]
    with pytest.raises(TooLarge):
        Kernel(compile_grammar('S = "b" | S S.'), most_items=50).parse("b" * 40)


def test_scan_and_reports():
    from spangrove.plans import scan as sc

    g = compile_grammar(SPACE + 'id - /[a-z]+/. S = "if" id { "," id } .')
    assert [(t.kind, t.start, t.end, t.trivia) for t in sc.scan(g, "if  ifx")] == [('"if"', 0, 2, ()), ("id", 4, 7, ((2, 4),)), ("○", 7, 7, ())]
    with pytest.raises(sc.ScanError):
        sc.scan(g, "if ?")
    p = Kernel(g).parse("if x\n, 9")
    assert sc.explain(p).startswith("no parse at L0P3") or "expected" in sc.explain(p)
    assert sc.explain(Kernel(g).parse("if x")) == "" and "first" in sc.describe(g)
    assert sc.literal_content(r'"a\\n\"\n"') == 'a\\n"\n' and sc.line_position("a\r\nbc", 5) == "L1P2"
    assert sc.keyword_overlaps(compile_grammar('@lexicalClass id - /[a-z]+/. S = "if" id "," .')) == [('"if"', "id")]
    t = sc.Telemetry()
    lexer = sc.Timed(p.lexer, t)
    p.lexer.memo.clear()
    assert lexer.lex(0, "id") == lexer.lex(0, "id") and t.calls == {"id": 1} and t.report()[0][:2] == ("id", 1) and lexer.text == p.text


def test_generated_recognizer():
    from spangrove.plans import scan as sc
    from spangrove.sources.codegen import recognizer

    g = compile_grammar(SPACE + 'n - /[0-9]+/. S = T { "+" T } [ ";" ]. T = n | "(" S ")" | "-" < n > .')
    scope: dict = {}
    exec(recognizer(g), scope)
    k = Kernel(g)
    for text in ("1", "1 + (2 + 3);", "- 1 2 3", "-", "1 +", "(1", "1 2", "1;;"):
        try:
            got = scope["parse"]([t.kind for t in sc.scan(g, text)])
        except ValueError:
            got = False
        assert got == k.parse(text).accepted, text
    with pytest.raises(GrammarError):
        recognizer(compile_grammar('S = "a" | "a" "b".'))


def test_registered_patterns():
    import regex

    from spangrove.functions.codepoints import PATTERNS, portable

    def whole(name, *texts):
        return [bool(regex.fullmatch(PATTERNS[name], t)) for t in texts]

    assert whole("identifier", "aB_1", "é́x", "日本", "😀", "1a", "⚽", "a-b") == [True, True, True, True, False, False, False]
    assert whole("operatorToken", "+", "==", "=", "?", "&&", "⚽", "a") == [True, True, False, False, True, True, False]
    assert whole("postfixOperatorToken", "++", "!=") == [True, False] and whole("dotOperator", "...", "..<", ".", ".?") == [True, True, False, False]
    assert whole("poundName", "#if", "#") == [True, False] and whole("propertyWrapperProjection", "$a", "$0a", "$0") == [True, True, False]
    assert whole("escapedIdentifier", "`class`", "`a b`", "`+`", "` `", "`a\nb`") == [True, True, False, False, False]
    assert regex.fullmatch(portable(r"[\u{61}-\u{7A}]+\\u{}"), "abc\\u{}")
    assert Kernel(compile_grammar("name - @builder(identifier) . S = name .")).parse("héllo").accepted
