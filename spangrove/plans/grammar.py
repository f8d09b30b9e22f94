"""Grammar texts compiled into immutable tables.

A grammar is a list of definitions that end in a full stop:

    name : /re/ .        trivia, skipped before and after tokens      name - /re/ .   a visible terminal ("lit" too)
    name = ... .         a rule; the first is the start               name =: ... .   trivia given by a rule
    name =| ... .        a rule that is recognised as one token       name - @builder(key) .  a registered pattern

Bodies have alternatives (|), ( ) [ ] { } < > and ? * +, literals, /regular expressions/, names, "" or ε, gaps
(<s> >s< <n> >n<), layout tokens (>>| and |<<), and after an element ---("x") for exclusion, >+>(..) and >->(..) for
the next token. After a terminal's full stop come <+<(..) and <-<(..) for the token before. Pragmas: @longest
@shortest @left @right on rules, @prefer before an alternative, @avoid inside a bracket, @lexicalClass,
@splitBefore("c") and @scalar before a terminal. 'text' is an action. ^^^ starts a message.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

from ..functions.codepoints import PATTERNS, portable

EOS, EPS = "○", ""
INDENT, DEDENT = ">>|", "|<<"
GAPS = ("<s>", ">s<", "<n>", ">n<")


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass
class Terminal:
    name: str
    source: str
    literal: bool = False
    skip: bool = False
    lexical_class: bool = False
    split_before: str | None = None
    lexical_rule: bool = False
    scalar: bool = False
    #: (positive, kinds of each rule of the line)
    behind: list[tuple[bool, list[frozenset[str]]]] = field(default_factory=list)


@dataclass(eq=False)
class Element:
    """One place in a body. kind: term, call, group, opt, star, plus, eps, gap."""

    kind: str
    name: str = ""
    alternatives: list[Alternative] = field(default_factory=list)
    exclude: set[str] = field(default_factory=set)
    ahead: set[str] = field(default_factory=set)
    not_ahead: set[str] = field(default_factory=set)
    avoid: bool = False
    actions: list[str] = field(default_factory=list)
    number: int = -1
    first: frozenset[str] = frozenset()
    follow: frozenset[str] = frozenset()

    @property
    def bracket(self) -> bool:
        return self.kind in ("group", "opt", "star", "plus")

    @property
    def closure(self) -> bool:
        return self.kind in ("star", "plus")


@dataclass(eq=False)
class Alternative:
    elements: list[Element]
    prefer: bool = False
    actions: list[str] = field(default_factory=list)
    owner: Rule | Element | None = None
    number: int = -1
    first: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()


@dataclass(eq=False)
class Rule:
    name: str
    alternatives: list[Alternative] = field(default_factory=list)
    trivia: bool = False
    lexical: bool = False
    choice: str | None = None
    signature: str | None = None
    number: int = -1
    first: frozenset[str] = frozenset()
    follow: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()

    kind = "rule"
    closure = False


@dataclass(eq=False)
class Grammar:
    start: str = ""
    terminals: dict[str, Terminal] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    messages: list[str] = field(default_factory=list)
    preamble: list[str] = field(default_factory=list)
    epilogue: list[str] = field(default_factory=list)
    layout: bool = False
    symbols: dict[str, int] = field(default_factory=dict)
    elements: list[Element] = field(default_factory=list)
    alternatives: list[Alternative] = field(default_factory=list)
    owner_numbers: int = 0
    #: The disambiguation rules, once they were asked for.
    choices: list | None = None

    @property
    def root(self) -> Rule:
        return self.rules[self.start]

    def in_rules(self) -> Iterable[tuple[Rule, Alternative, int, Element]]:
        """Every element with its rule, its alternative and its place there."""

        def walk(rule: Rule, alternatives: list[Alternative]):
            for a in alternatives:
                for p, e in enumerate(a.elements):
                    yield rule, a, p, e
                    yield from walk(rule, e.alternatives)

        for name in sorted(self.rules):
            yield from walk(self.rules[name], self.rules[name].alternatives)


_TOKENS = [
    ("trivia", r"\s+|//[^\n]*|/\*.*?\*/"),
    ("message", r"\^\^\^.*?(?=\^\^\^|\z)"),
    ("action", r"'(?:[^'\\]|\\.)*'"),
    ("empty", r'""'),
    ("literal", r'"(?:[^"\\]|\\.)+"'),
    ("pragma", r"@\p{XID_Start}\p{XID_Continue}*"),
    ("ε", "ε"),
    ("name", r"\p{XID_Start}\p{XID_Continue}*"),
    ("regex", r"/(?!\*)(?:[^/\\]|\\.)+/"),
    ("mark", r"---|>\+>|>->|<\+<|<-<|>>\||\|<<|<[sn]>|>[sn]<|=:|=\||[.:=|()\[\]{}<>?*+,-]"),
]
_SCANNER = regex.compile("|".join(f"(?P<g{i}>{p})" for i, (_, p) in enumerate(_TOKENS)), regex.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCANNER.match(text, at)
        if not m:
            raise GrammarError(f"unexpected {text[at : at + 20]!r} at {at}")
        kind = _TOKENS[int(m.lastgroup[1:])][0]
        if kind != "trivia":
            out.append(Token(m[0] if kind == "mark" else kind, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


#: The escapes of literals, replaced one after another in this order.
ESCAPES = [("\\0", "\0"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")]


def unescape(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


class Reader:
    def __init__(self, text: str, builders: dict[str, str] | None = None):
        self.text, self.builders = text, PATTERNS | (builders or {})
        self.tokens, self.at = tokenize(text), 0
        self.grammar = Grammar()
        self.aliases: dict[str, str] = {}
        self.symbols: dict[str, None] = {}

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def take(self, *kinds: str) -> Token:
        t = self.token
        if kinds and t.kind not in kinds:
            raise GrammarError(f"{t.text!r} at {t.at}: expected one of {' '.join(kinds)}")
        self.at += 1
        return t

    def pragma(self, *names: str) -> str | None:
        if self.token.kind == "pragma" and self.token.text[1:] in names:
            return self.take().text[1:]
        return None

    def actions(self) -> list[str]:
        out = []
        while self.token.kind == "action":
            out.append(self.take().text[1:-1])
        return out

    def read(self) -> Grammar:
        g = self.grammar
        g.preamble = self.actions()
        while self.token.kind in ("name", "pragma"):
            self.definition()
        g.epilogue = self.actions()
        while self.token.kind == "message":
            g.messages.append(self.take().text[3:])
        self.take("end")
        if not g.start:
            raise GrammarError("no rule")
        return g

    def definition(self) -> None:
        choice = self.pragma("longest", "shortest", "left", "right")
        lexical_class = self.pragma("lexicalClass")
        split = None
        if self.pragma("splitBefore"):
            self.take("(")
            split = unescape(self.take("literal").text[1:-1])[:1]
            self.take(")")
        scalar = self.pragma("scalar")
        name = self.take("name").text
        if self.token.kind in (":", "-"):
            t = self.terminal(name, self.take().kind == ":")
            t.lexical_class, t.split_before, t.scalar = bool(lexical_class), split, bool(scalar)
            self.take(".")
            while self.token.kind in ("<+<", "<-<"):
                t.behind.append(self.behind())
            return
        signature = self.actions()
        kind = self.take("=", "=:", "=|").kind
        g = self.grammar
        if kind == "=" and not g.start:
            g.start = name
        alternatives = self.selection()
        self.take(".")
        rule = g.rules.setdefault(name, Rule(name))
        rule.alternatives += alternatives
        rule.trivia |= kind == "=:"
        if kind == "=|":
            rule.lexical = True
            g.terminals.setdefault(name, Terminal(name, "", lexical_rule=True))
            self.symbols.setdefault(name)
        rule.choice = choice or rule.choice
        rule.signature = signature[0] if signature else rule.signature

    def terminal(self, name: str, skip: bool) -> Terminal:
        t = self.token
        if t.kind == "regex":
            self.take()
            return self.pattern(name, t.text[1:-1], skip)
        if t.kind in ("literal", "empty"):
            found = self.literal(skip)
            self.aliases[name] = found.name
            return found
        if not self.pragma("builder"):
            self.take("regex", "literal")
        key = name
        if self.token.kind == "(":
            self.take()
            key = self.take("name", "literal").text.strip('"')
            self.take(")")
        if key not in self.builders:
            raise GrammarError(f"no registered pattern {key!r} for {name}")
        return self.pattern(name, self.builders[key], skip)

    def pattern(self, name: str, source: str, skip: bool) -> Terminal:
        source = portable(source)
        try:
            regex.compile(source)
        except regex.error as e:
            raise GrammarError(f"bad pattern of {name}: {e}") from e
        self.symbols.setdefault(name)
        self.grammar.terminals[name] = Terminal(name, source, skip=skip)
        return self.grammar.terminals[name]

    def literal(self, skip: bool = False) -> Terminal:
        text = self.take("literal").text
        self.symbols.setdefault(text)
        return self.grammar.terminals.setdefault(text, Terminal(text, unescape(text[1:-1]), literal=True, skip=skip))

    def behind(self) -> tuple[bool, list[frozenset[str]]]:
        heads, rules = set(), []
        while True:
            heads.add(self.take("<+<", "<-<").kind)
            rules.append(frozenset(self.kinds()))
            if self.token.kind != ",":
                break
            self.take()
        if len(heads) > 1:
            raise GrammarError("one line of rules about the token before mixes both polarities")
        return "<+<" in heads, rules

    def kinds(self) -> list[str]:
        self.take("(")
        out = []
        while self.token.kind in ("literal", "name"):
            t = self.take()
            out.append(t.text if t.kind == "literal" else self.aliases.get(t.text, t.text))
        self.take(")")
        return out

    def selection(self) -> list[Alternative]:
        out = [self.sequence()]
        while self.token.kind == "|":
            self.take()
            out.append(self.sequence())
        return out

    def sequence(self) -> Alternative:
        prefer = bool(self.pragma("prefer"))
        out = Alternative([], prefer, self.actions())
        while True:
            kind = self.token.kind
            if kind in GAPS:
                e = Element("gap", self.take().text)
                self.symbols.setdefault(e.name)
            elif kind in (INDENT, DEDENT):
                self.grammar.layout = True
                e = Element("term", self.take().text)
                self.symbols.setdefault(e.name)
            elif kind in ("name", "literal", "regex", "empty", "ε", "(", "[", "{", "<"):
                e = self.factor()
                if self.token.kind in "?*+":
                    e = Element({"?": "opt", "*": "star", "+": "plus"}[self.take().kind], alternatives=[Alternative([e])])
            elif out.elements:
                return out
            else:
                self.take("name", "literal", "regex", "empty", "ε", "(", "[", "{", "<", *GAPS)
            out.elements.append(e)
            e.actions = self.actions()

    def factor(self) -> Element:
        t = self.token
        if t.kind == "name":
            self.take()
            known = self.aliases.get(t.text, t.text)
            e = Element("term" if known in self.grammar.terminals else "call", known)
        elif t.kind == "literal":
            e = Element("term", self.literal().name)
        elif t.kind == "regex":
            self.take()
            before = self.text[: t.at].split("\n")
            e = Element("term", self.pattern(f"L{len(before) - 1}P{len(before[-1])}", t.text[1:-1], False).name)
        elif t.kind in ("empty", "ε"):
            self.take()
            e = Element("eps", "ε")
        else:
            opened = self.take().kind
            kind, closer = {"(": ("group", ")"), "[": ("opt", "]"), "{": ("star", "}"), "<": ("plus", ">")}[opened]
            avoid = opened != "(" and bool(self.pragma("avoid"))
            e = Element(kind, alternatives=self.selection(), avoid=avoid)
            self.take(closer)
        if self.token.kind == "---":
            self.take()
            e.exclude = {k for k in self.kinds() if k.startswith('"')}
        if self.token.kind in (">+>", ">->"):
            target = e.ahead if self.take().kind == ">+>" else e.not_ahead
            target.update(self.kinds())
        return e


BRACKETS = {"group": "( )", "opt": "[ ]", "star": "{ }", "plus": "< >"}


def compile_grammar(text: str, builders: dict[str, str] | None = None, start: str = "") -> Grammar:
    """Read, number and analyse a grammar. builders: patterns by key for @builder, beside those that are there."""
    from .analysis import analyse

    reader = Reader(text, builders)
    g = reader.read()
    g.start = start or g.start
    if g.start not in g.rules:
        raise GrammarError(f"no rule {g.start!r}")
    g.symbols = {EOS: 0} | {s: i + 1 for i, s in enumerate(reader.symbols)}
    g.symbols[EPS] = len(g.symbols)
    number = 0
    # Owners (rules by descending name, then brackets) come before elements of plain kinds.
    for name in sorted(g.rules, reverse=True):
        g.rules[name].number = number
        number += 1
    for rule, _, _, e in g.in_rules():
        if e.bracket:
            e.number, e.name = number, e.name or BRACKETS[e.kind]
            number += 1
        if e.kind == "call" and e.name not in g.rules:
            hint = " (it is a terminal that is defined later)" if e.name in g.terminals else ""
            raise GrammarError(f"{e.name!r} in {rule.name!r} is not defined{hint}")
    g.owner_numbers = number
    for _, a, _, e in g.in_rules():
        if not e.bracket:
            e.number = number
            number += 1
        g.elements.append(e)
    g.elements.sort(key=lambda e: e.number)

    def own(owner: Rule | Element) -> None:
        for a in owner.alternatives:
            a.owner, a.number = owner, len(g.alternatives)
            g.alternatives.append(a)
            for e in a.elements:
                own(e)

    for name in sorted(g.rules):
        own(g.rules[name])
    analyse(g)
    return g


def ebnf(x: Grammar | Rule | Alternative | Element, dot: int = -1) -> str:
    """Canonical text; in an alternative a dot may mark a place."""
    if isinstance(x, Grammar):
        return "\n".join(ebnf(x.rules[n]) for n in sorted(x.rules, key=lambda n: (n != x.start, n)))
    if isinstance(x, Rule):
        return f"{x.name} = {' | '.join(map(ebnf, x.alternatives))} ."
    if isinstance(x, Alternative):
        words = [ebnf(e) for e in x.elements]
        if dot >= 0:
            words.insert(dot, "·")
        return " ".join(words)
    if x.bracket:
        a, b = BRACKETS[x.kind].split()
        return f"{a} {' | '.join(map(ebnf, x.alternatives))} {b}"
    return x.name
