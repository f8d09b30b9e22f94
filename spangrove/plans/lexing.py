"""Terminals matched on demand at positions (code points) of one message."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import regex

from .grammar import DEDENT, EOS, INDENT, Grammar

QUOTES = ("'''", '"""', "'", '"')


class Match(NamedTuple):
    start: int
    end: int
    #: after the trivia behind it
    after: int


def layout_tokens(text: str, tab: int = 8, openers: str = "([{", closers: str = ")]}") -> dict[int, list[str]]:
    """Indents and dedents at the first visible character of lines, outside brackets; the rest at the end.

    Blank lines and lines of a # comment say nothing. A line that comes back to a column between two levels closes
    the deeper ones and opens none. A CRLF is one line break.
    """
    out: dict[int, list[str]] = {}
    levels, depth, at = [0], 0, 0
    fresh = True
    while at < len(text):
        if fresh:
            column = 0
            while at < len(text) and text[at] in " \t":
                column += 1 if text[at] == " " else tab - column % tab
                at += 1
            fresh = False
            if at < len(text) and text[at] not in "\r\n#" and not depth:
                if column > levels[-1]:
                    levels.append(column)
                    out[at] = [INDENT]
                else:
                    closed = [x for x in levels[1:] if x > column]
                    if closed:
                        out[at] = [DEDENT] * len(closed)
                        del levels[-len(closed) :]
            continue
        c = text[at]
        if c in "\r\n":
            at += 2 if text[at : at + 2] == "\r\n" else 1
            fresh = True
        elif c == "#":
            while at < len(text) and text[at] not in "\r\n":
                at += 1
        elif c in "'\"":
            at = _after_string(text, at)
        else:
            depth = depth + 1 if c in openers else max(0, depth - 1) if c in closers else depth
            at += 1
    if len(levels) > 1:
        out.setdefault(len(text), []).extend([DEDENT] * (len(levels) - 1))
    return out


def _after_string(text: str, at: int) -> int:
    quote = next(q for q in QUOTES if text.startswith(q, at))
    at += len(quote)
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text.startswith(quote, at):
            return at + len(quote)
        elif len(quote) == 1 and text[at] in "\r\n":
            return at
        else:
            at += 1
    return len(text)


class Patterns:
    """The compiled terminals of a grammar; shared by all messages of a worker."""

    def __init__(self, g: Grammar):
        visible = {n: t for n, t in g.terminals.items() if not t.lexical_rule}
        self.literals = {n: t.source for n, t in visible.items() if t.literal}
        self.regexes = {n: regex.compile(t.source) for n, t in visible.items() if not t.literal and not t.skip}
        self.trivia = [regex.compile(regex.escape(t.source) if t.literal else t.source) for t in visible.values() if t.skip]
        self.classes = [(n, self.regexes[n]) for n, t in visible.items() if t.lexical_class and n in self.regexes]


class Lexer:
    def __init__(self, g: Grammar, patterns: Patterns, text: str, recognise: Callable[[str, int], int | None] | None):
        """recognise(rule, at): the end of the longest match of a trivia or lexical rule; None inside such a rule."""
        self.g, self.p, self.text, self.recognise = g, patterns, text, recognise
        self.layout = layout_tokens(text) if g.layout and recognise else {}
        self.trivia_rules = [r.name for r in g.rules.values() if r.trivia] if recognise else []
        self.memo: dict[tuple[int, str], tuple[Match, ...]] = {}
        self.skipped: dict[int, int] = {}

    def skip(self, at: int) -> int:
        """The end of the trivia that begins here."""
        if not self.recognise:
            return at
        if at in self.skipped:
            return self.skipped[at]
        begin, moved = at, True
        while moved and at < len(self.text):
            moved = False
            for p in self.p.trivia:
                m = p.match(self.text, at)
                if m and m.end() > at:
                    at, moved = m.end(), True
                    break
            else:
                for rule in self.trivia_rules:
                    end = self.recognise(rule, at)
                    if end is not None and end > at:
                        at, moved = end, True
                        break
        self.skipped[begin] = at
        return at

    def lex(self, at: int, terminal: str) -> tuple[Match, ...]:
        key = at, terminal
        if key not in self.memo:
            self.memo[key] = tuple(self._lex(self.skip(at), terminal))
        return self.memo[key]

    def _lex(self, at: int, terminal: str) -> list[Match]:
        text = self.text
        if terminal in self.layout.get(at, ()):
            return [Match(at, at, at)]
        if terminal == EOS:
            return [Match(at, at, at)] if at == len(text) else []
        if at >= len(text):
            return []
        if terminal in self.p.literals:
            source = self.p.literals[terminal]
            if not text.startswith(source, at):
                return []
            end = at + len(source)
            # A longer word of a lexical class hides the literal.
            if any(n != terminal and (m := p.match(text, at)) and m.end() > end for n, p in self.p.classes):
                return []
            return [Match(at, end, self.skip(end))]
        if terminal in self.p.regexes:
            m = self.p.regexes[terminal].match(text, at)
            if not m or m.end() == at:
                return []
            out = [Match(at, m.end(), self.skip(m.end()))]
            split = self.g.terminals[terminal].split_before
            if split:
                out += [Match(at, i, i) for i in range(at + 1, m.end()) if text[i] == split]
            return out
        found = self.g.terminals.get(terminal)
        if found and found.lexical_rule and self.recognise:
            end = self.recognise(terminal, at)
            return [Match(at, end, self.skip(end))] if end is not None and end > at else []
        return []
