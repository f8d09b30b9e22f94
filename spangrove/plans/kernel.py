"""The parse of one message: all derivations of a text as a set of spans.

The state is a chart of facts that only grows, worked off first in, first out:

    an item     (alternative, dot, begin, vertex): the body was matched from one vertex up to another
    a need      (owner, begin): somebody waits for a rule or bracket that begins there
    an end      (owner, begin, vertex): it can end there

A vertex is a position, together with the token that led to it where the grammar looks back (gaps and conditions on
the token before), so the answers of such conditions depend on the derivation and not on the order of the work.
Closures keep one need for each place where they begin and one for each iteration; an iteration knows the places from
which its closure began, so a list of n elements makes n iterations, not n lists.

A span (element, i, k, j) says: in a body that begins at i the element covers k to j. For an owner i = k.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import cached_property

from .grammar import EOS, EPS, Alternative, Element, Grammar, Rule
from .lexing import Lexer, Match, Patterns


class TooLarge(RuntimeError):
    """A message needs more items than its limit allows."""


@dataclass
class Parse:
    grammar: Grammar
    text: str
    lexer: Lexer
    root: Rule
    start: int
    spans: dict[int, set[tuple[int, int, int]]] = field(default_factory=dict)
    #: terminal, trivia start, start, end, trivia end
    commits: set[tuple[str, int, int, int, int]] = field(default_factory=set)
    items: int = 0
    duplicates: int = 0
    suppressed: int = 0
    needs: int = 0
    failed: int = 0
    furthest: int = 0
    expected: set[str] = field(default_factory=set)

    def ends(self) -> list[int]:
        """Where the root ends so that nothing but trivia is left."""
        n = len(self.text)
        return sorted(j for i, _, j in self.spans.get(self.root.number, ()) if i == self.start and self.lexer.skip(j) == n)

    @property
    def accepted(self) -> bool:
        return bool(self.ends())

    @property
    def exact(self) -> bool:
        """The root covers the whole text."""
        return (self.start, self.start, len(self.text)) in self.spans.get(self.root.number, ())

    def span_count(self) -> int:
        return sum(map(len, self.spans.values()))


class Kernel:
    """A grammar made ready to parse many messages."""

    def __init__(self, grammar: Grammar, most_items: int = 5_000_000):
        self.g, self.most_items = grammar, most_items
        self.patterns = Patterns(grammar)
        self.looks_back = any(e.kind == "gap" for e in grammar.elements) or any(t.behind for t in grammar.terminals.values())

    @cached_property
    def names(self) -> dict[int, str]:
        """Terminals by their symbol numbers."""
        return {n: name for name, n in self.g.symbols.items()}

    @cached_property
    def shaped(self) -> bool:
        """Does a parse depend on nothing but which terminals match where?"""
        rules, terminals = self.g.rules.values(), self.g.terminals.values()
        return not (self.looks_back or self.g.layout or any(r.trivia for r in rules) or any(t.lexical_rule or t.split_before for t in terminals))

    @cached_property
    def _first(self) -> dict[str, list[tuple[str, str]]]:
        """The literals by their first characters."""
        out: dict[str, list[tuple[str, str]]] = {}
        for name, source in self.patterns.literals.items():
            out.setdefault(source[:1], []).append((name, source))
        return out

    @cached_property
    def _classes(self) -> set[str]:
        return {name for name, _ in self.patterns.classes}

    def shape(self, text: str) -> tuple[tuple, list[int], dict[tuple[str, int], Match]]:
        """What decides about the parse of a text: the places that tokens lead to, in order, and the terminals that match
        at each, by the numbers of the places they lead to. Also the places themselves, and each match."""
        n, p, first = len(text), self.patterns, self._first
        regexes, trivia = [(name, x.match) for name, x in p.regexes.items()], [x.match for x in p.trivia]
        skipped: dict[int, int] = {}

        def skip(at: int) -> int:
            begin = at
            if begin not in skipped:
                moved = True
                while moved and at < n:
                    moved = False
                    for match in trivia:
                        if (m := match(text, at)) and m.end() > at:
                            at, moved = m.end(), True
                            break
                skipped[begin] = at
            return skipped[begin]

        found: dict[int, list[tuple[str, int]]] = {}
        matches: dict[tuple[str, int], Match] = {}
        todo = [0]
        while todo:
            place = todo.pop()
            if place in found:
                continue
            found[place] = here = []
            at = skip(place)
            if at >= n:
                here.append((EOS, n))
                matches[EOS, place] = Match(n, n, n)
                todo.append(n)
                continue
            ends = [(name, m.end()) for name, match in regexes if (m := match(text, at)) and m.end() > at]
            longest = [(name, end) for name, end in ends if name in self._classes]
            for name, source in first.get(text[at], ()):
                end = at + len(source)
                # A longer word of a lexical class hides the literal.
                if text.startswith(source, at) and not any(e > end for _, e in longest):
                    after = skip(end)
                    here.append((name, after))
                    matches[name, place] = Match(at, end, after)
            for name, end in ends:
                after = skip(end)
                here.append((name, after))
                matches[name, place] = Match(at, end, after)
            todo += [after for _, after in here]
        places = sorted(found)
        number = {at: i for i, at in enumerate(places)}
        return tuple((at == n, *((name, number[after]) for name, after in found[at])) for at in places), places, matches

    def parse(self, text: str) -> Parse:
        known: dict[tuple[str, int], int | None] = {}
        inner = Lexer(self.g, self.patterns, text, None)

        def recognise(rule: str, at: int) -> int | None:
            key = rule, at
            if key not in known:
                sub = self._run(text, inner, self.g.rules[rule], at, True)
                known[key] = max((j for i, _, j in sub.spans.get(sub.root.number, ()) if i == at), default=None)
            return known[key]

        return self._run(text, Lexer(self.g, self.patterns, text, recognise), self.g.root, 0, False)

    def _run(self, text: str, lexer: Lexer, root: Rule, start: int, inside: bool) -> Parse:
        g, out, n = self.g, Parse(self.g, text, lexer, root, start), len(text)
        lex, spans = lexer.lex, out.spans
        out.furthest = start
        # Vertices: position, end and terminal of the token before (-1 and '' for none).
        place: list[tuple[int, int, str]] = []
        vertex_of: dict[tuple[int, int, str], int] = {}

        def vertex(at: int, end: int = -1, terminal: str = "") -> int:
            key = (at, end, terminal) if self.looks_back else (at, -1, "")
            if key not in vertex_of:
                vertex_of[key] = len(place)
                place.append(key)
            return vertex_of[key]

        def miss(expected: frozenset[str] | set[str], at: int) -> None:
            out.failed += 1
            if at > out.furthest:
                out.furthest, out.expected = at, set()
            if at == out.furthest:
                out.expected |= expected - {EPS}

        def any_of(kinds, at: int) -> bool:
            return any(k != EPS and lex(at, k) for k in kinds)

        def free(kinds, at: int, exclude: frozenset[str]) -> bool:
            """Some kind matches here otherwise than as an excluded one."""
            if not exclude:
                return any_of(kinds, at)
            return any(all(m.after != x.after for e in exclude if e != k for x in lex(at, e)) for k in kinds if k != EPS for m in lex(at, k))

        def selects(a: Alternative, owner: Rule | Element, at: int) -> bool:
            if free(a.first, at, a.exclude):
                return True
            return EPS in a.first and (inside and owner is root or free(owner.follow, at, a.exclude))

        def viable(a: Alternative, dot: int, at: int) -> bool:
            if dot == len(a.elements):
                return True
            first = a.elements[dot].first
            return EPS in first or any_of(first, at)

        seen: set[tuple[int, int, int, int]] = set()
        agenda: deque[tuple[int, int, int, int]] = deque()

        def add(a: Alternative, dot: int, begin: int, v: int) -> None:
            item = a.number, dot, begin, v
            if item in seen:
                out.duplicates += 1
                return
            seen.add(item)
            out.items += 1
            if out.items > self.most_items:
                raise TooLarge(f"more than {self.most_items} items")
            agenda.append(item)

        def mark(e: Rule | Element, i: int, k: int, j: int) -> None:
            spans.setdefault(e.number, set()).add((i, k, j))

        Key = tuple[int, int]
        waiting: dict[Key, set[tuple[int, int, int]]] = {}
        ended: dict[Key, set[int]] = {}
        # For closures: the iterations from a place, where each closure began that reaches it, and where they end.
        begun: dict[Key, set[int]] = {}
        iterated: dict[Key, set[int]] = {}

        def advance(a: Alternative, dot: int, begin: int, k: int, v: int) -> None:
            at = place[v][0]
            if viable(a, dot + 1, at):
                mark(a.elements[dot], place[begin][0], k, at)
                add(a, dot + 1, begin, v)
            else:
                out.suppressed += 1
                miss(a.elements[dot + 1].first, at)

        def open_(owner: Rule | Element, v: int) -> None:
            at = place[v][0]
            chosen = [a for a in owner.alternatives if selects(a, owner, at)]
            for a in chosen:
                add(a, 0, v, v)
            if not chosen:
                miss(owner.first, at)

        def begin_iteration(e: Element, origin: int, v: int) -> None:
            origins = begun.setdefault((e.number, v), set())
            if origin in origins:
                return
            origins.add(origin)
            if len(origins) == 1:
                open_(e, v)
            for w in list(iterated.get((e.number, v), ())):
                finish_closure(e, origin, w)

        def finish_closure(e: Element, origin: int, w: int) -> None:
            end(e, origin, w)
            if place[w][0] > place[origin][0]:
                begin_iteration(e, origin, w)

        def end(owner: Rule | Element, v: int, w: int) -> None:
            found = ended.setdefault((owner.number, v), set())
            if w in found:
                return
            found.add(w)
            for number, dot, begin in list(waiting.get((owner.number, v), ())):
                advance(g.alternatives[number], dot, begin, place[v][0], w)

        def need(owner: Rule | Element, a: Alternative, dot: int, begin: int, v: int) -> None:
            mine = waiting.setdefault((owner.number, v), set())
            waiter = a.number, dot, begin
            if waiter in mine:
                return
            mine.add(waiter)
            if len(mine) == 1 and (owner is not root or v != first):
                out.needs += 1
                if owner.closure:
                    begin_iteration(owner, v, v)
                else:
                    open_(owner, v)
            for w in list(ended.get((owner.number, v), ())):
                advance(a, dot, begin, place[v][0], w)

        def complete(owner: Rule | Element, begin: int, w: int) -> None:
            at = place[begin][0]
            mark(owner, at, at, place[w][0])
            if not owner.closure:
                end(owner, begin, w)
                return
            done = iterated.setdefault((owner.number, begin), set())
            if w not in done:
                done.add(w)
                for origin in list(begun.get((owner.number, begin), ())):
                    finish_closure(owner, origin, w)

        first = vertex(start)
        out.needs += 1
        open_(root, first)
        while agenda:
            number, dot, begin, v = agenda.popleft()
            a = g.alternatives[number]
            at, before_end, before = place[v]
            if dot == len(a.elements):
                owner = a.owner
                if isinstance(owner, Rule):
                    if owner is root and (inside or at == n) or any_of(owner.follow, at):
                        complete(owner, begin, v)
                    else:
                        miss(owner.follow, at)
                else:
                    complete(owner, begin, v)
                continue
            e = a.elements[dot]
            if e.kind == "eps":
                mark(e, place[begin][0], at, at)
                add(a, dot + 1, begin, v)
            elif e.kind == "gap":
                if self._gap(e.name, text, lexer, at, before_end):
                    mark(e, place[begin][0], at, at)
                    add(a, dot + 1, begin, v)
                else:
                    miss({e.name}, at)
            elif e.kind == "term":
                found = self._match(e, lexer, at, before, n, inside)
                if not found:
                    miss({e.name}, at)
                for m in found:
                    mark(e, place[begin][0], at, m.after)
                    out.commits.add((e.name, at, m.start, m.end, m.after))
                    add(a, dot + 1, begin, vertex(m.after, m.end, e.name))
            elif e.kind == "call":
                need(g.rules[e.name], a, dot, begin, v)
            else:
                if e.kind in ("opt", "star"):
                    if viable(a, dot + 1, at):
                        mark(e, place[begin][0], at, at)
                        add(a, dot + 1, begin, v)
                    else:
                        miss(a.elements[dot + 1].first, at)
                need(e, a, dot, begin, v)
        return out

    def _gap(self, kind: str, text: str, lexer: Lexer, at: int, before_end: int) -> bool:
        """What lies between the token before (or here, at the start, and the next token) and this place."""
        if kind == "<n>" and at == len(text):
            return True
        gap = text[before_end:at] if before_end >= 0 else text[at : lexer.skip(at)]
        found = bool(gap) if "s" in kind else "\n" in gap or "\r" in gap
        return found == kind.startswith("<")

    def _match(self, e: Element, lexer: Lexer, at: int, before: str, n: int, inside: bool) -> list[Match]:
        found = list(lexer.lex(at, e.name))
        if not found:
            return []
        terminal = self.g.terminals.get(e.name)
        if terminal and terminal.behind and not looks_back_ok(terminal.behind, before):
            if terminal.split_before is None:
                return []
            longest = max(m.end for m in found)
            found = [m for m in found if m.end == longest]
        if e.exclude:
            taken = {x.after for k in e.exclude if k != e.name for x in lexer.lex(at, k)}
            found = [m for m in found if m.after not in taken]
        wanted = e.ahead or (frozenset() if inside else e.follow)  # what follows a trivia or lexical rule isn't known
        if wanted and EPS not in wanted:
            found = [m for m in found if m.after >= n or any(lexer.lex(m.after, k) for k in wanted)]
        if e.not_ahead:
            found = [m for m in found if m.after >= n or not any(lexer.lex(m.after, k) for k in e.not_ahead)]
        distinct: dict[int, Match] = {}
        for m in found:
            distinct.setdefault(m.after, m)
        return list(distinct.values())


def looks_back_ok(lines: list[tuple[bool, list[frozenset[str]]]], before: str) -> bool:
    holds = [(positive, all(before in kinds for kinds in rules)) for positive, rules in lines]
    if any(h for p, h in holds if p):
        return True
    if any(h for p, h in holds if not p):
        return False
    return not all(p for p, _ in holds)


__all__ = ["EOS", "Kernel", "Parse", "TooLarge"]
