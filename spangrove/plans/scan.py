"""Scanning a whole text at once, telemetry of terminals, and reports about texts that do not parse."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import NamedTuple

import regex

from .grammar import EOS, Grammar, ebnf
from .kernel import Parse
from .lexing import Match, Patterns


class ScanError(ValueError):
    pass


class Scanned(NamedTuple):
    kind: str
    start: int
    end: int
    #: what was skipped before it
    trivia: tuple[tuple[int, int], ...]


def scan(g: Grammar, text: str) -> list[Scanned]:
    """All tokens and an end token: at each place the longest match wins, and of equals a visible literal."""
    candidates = [(t, regex.compile(regex.escape(t.source) if t.literal else t.source)) for t in g.terminals.values() if not t.lexical_rule]
    out: list[Scanned] = []
    at, trivia = 0, []
    while at < len(text):
        found = [(m.end(), t.literal and not t.skip, t) for t, p in candidates if (m := p.match(text, at))]
        if not found:
            raise ScanError(f"no token at {line_position(text, at)}: {text[at : at + 20]!r}")
        end, _, best = max(found, key=lambda x: x[:2])
        if end == at:
            raise ScanError(f"{best.name} matches nothing at {line_position(text, at)}")
        if best.skip:
            trivia.append((at, end))
        else:
            out.append(Scanned(best.name, at, end, tuple(trivia)))
            trivia = []
        at = end
    return [*out, Scanned(EOS, at, at, tuple(trivia))]


def line_position(text: str, at: int) -> str:
    """L<line>P<column>, from 0."""
    lines = regex.split(r"\r\n|\n|\r", text[:at])
    return f"L{len(lines) - 1}P{len(lines[-1])}"


SLOW = (0.25, 1.0)


@dataclass
class Telemetry:
    """Calls and seconds of each terminal, and matches slower than SLOW."""

    calls: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    slow: list[tuple[str, int, float, bool]] = field(default_factory=list)

    def add(self, kind: str, at: int, took: float) -> None:
        self.calls[kind] = self.calls.get(kind, 0) + 1
        self.seconds[kind] = self.seconds.get(kind, 0.0) + took
        if took > SLOW[0]:
            self.slow.append((kind, at, took, took > SLOW[1]))

    def report(self, most: int = 10) -> list[tuple[str, int, float]]:
        return sorted(((k, n, self.seconds[k]) for k, n in self.calls.items()), key=lambda r: (-r[2], r[0]))[:most]


class Timed:
    """A lexer that keeps telemetry of what is not remembered yet."""

    def __init__(self, lexer, telemetry: Telemetry):
        self.lexer, self.telemetry = lexer, telemetry

    def __getattr__(self, name: str):
        return getattr(self.lexer, name)

    def lex(self, at: int, terminal: str) -> tuple[Match, ...]:
        if (at, terminal) in self.lexer.memo:
            return self.lexer.memo[at, terminal]
        began = time.perf_counter()
        out = self.lexer.lex(at, terminal)
        self.telemetry.add(terminal, at, time.perf_counter() - began)
        return out


def explain(p: Parse, recent: int = 5) -> str:
    """Why a text has no parse: where, what stands there, what was expected, and the last tokens before."""
    if p.accepted:
        return ""
    found = regex.match(r"\S{0,30}", p.text[p.furthest :])[0] or p.text[p.furthest : p.furthest + 1]
    before = sorted((c for c in p.commits if c[4] <= p.furthest), key=lambda c: (c[4], c[0]))[-recent:]
    lines = [f"no parse at {line_position(p.text, p.furthest)}", f"found: {found!r}", f"expected: {', '.join(sorted(p.expected))}"]
    return "\n".join([*lines, *(f"  {line_position(p.text, c[2])} {c[0]} {p.text[c[2] : c[3]]!r}" for c in before)])


def keyword_overlaps(g: Grammar) -> list[tuple[str, str]]:
    """(literal, terminal): words that a lexical class, or a terminal used next to an exclusion, matches as a whole."""
    patterns = Patterns(g)
    watched = {n for n, t in g.terminals.items() if t.lexical_class} | {e.name for e in g.elements if e.kind == "term" and e.exclude}
    return sorted((lit, n) for lit, source in patterns.literals.items() for n in watched if n in patterns.regexes and patterns.regexes[n].fullmatch(source))


def literal_content(literal: str) -> str:
    """What a quoted literal says, unescaped from left to right."""
    return regex.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), literal[1:-1], flags=regex.S)


def describe(g: Grammar) -> str:
    """The grammar as text with each rule's FIRST and FOLLOW."""
    out = []
    for r in sorted(g.rules.values(), key=lambda r: (r.name != g.start, r.name)):
        out += [ebnf(r), f"  first  {' '.join(sorted(r.first))}", f"  follow {' '.join(sorted(r.follow))}"]
    return "\n".join(out)
