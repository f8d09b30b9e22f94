"""The shape of a text against the lexer asked for each terminal at each place."""

import random

from spangrove.operators.parse import kernel
from spangrove.plans import kernel as plans
from spangrove.plans.grammar import EOS
from spangrove.plans.lexing import Lexer
from spangrove.queries import AMBIGUOUS, ARITHMETIC, TURN

WORDS = r"""
blank : /[ \t]+/ .
note : /#[^#]*#/ .
dash : "--" .
@lexicalClass word - /[a-z]+/ .
odd - /a*/ .
S = { word | odd | "ab" | "a" | "abc" | "-" | "->" } .
"""


def plain(k, text):
    lexer, found, matches, todo = Lexer(k.g, k.patterns, text, lambda *_: None), {}, {}, [0]
    while todo:
        at = todo.pop()
        if at not in found:
            found[at] = []
            for name in (EOS, *k.patterns.literals, *k.patterns.regexes):
                for m in lexer.lex(at, name):
                    found[at].append((name, m.after))
                    matches[name, at] = m
                    todo.append(m.after)
    places = sorted(found)
    return [(at == len(text), sorted((name, places.index(after)) for name, after in found[at])) for at in places], places, matches


def test_shapes(monkeypatch):
    rnd = random.Random(4)
    for grammar, letters in ((ARITHMETIC, "12+*() \n"), (AMBIGUOUS, "12+* "), (TURN, "ab,. \n"), (WORDS, "abc->#é \t")):
        k = kernel(grammar)
        assert k.shaped
        texts = ["", " ", "  1", *("".join(rnd.choice(letters) for _ in range(rnd.randrange(14))) for _ in range(1500))]
        want = [plain(k, t) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(plans, "Lexer", None)  # each place is read once, without one question for each terminal
            for t, (shape, places, matches) in zip(texts, want, strict=True):
                got = k.shape(t)
                assert ([(x[0], sorted(x[1:])) for x in got[0]], got[1], got[2]) == (shape, places, matches), t
