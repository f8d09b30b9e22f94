"""FIRST and FOLLOW, propagated exclusions, and LL(1) conflicts of a grammar: fixpoints over a small graph."""

from __future__ import annotations

import regex

from .grammar import EOS, EPS, Alternative, Element, Grammar, Rule

Owner = Rule | Element


def analyse(g: Grammar) -> None:
    first: dict[int, set[str]] = {}

    def own(e: Element) -> set[str]:
        """FIRST of the element alone; EPS in it if it can be empty."""
        if e.kind == "term":
            return {e.name}
        if e.kind in ("eps", "gap"):
            return {EPS}
        if e.kind == "call":
            return first.get(g.rules[e.name].number, set())
        return first.get(e.number, set()) | ({EPS} if e.kind in ("opt", "star") else set())

    def suffix(elements: list[Element]) -> set[str]:
        out: set[str] = {EPS}
        for e in reversed(elements):
            mine = own(e)
            out = mine - {EPS} | out if EPS in mine else set(mine)
        return out

    owners: list[Owner] = [*g.rules.values(), *(e for e in g.elements if e.bracket)]
    grown = True
    while grown:
        grown = False
        for o in owners:
            new = set().union(*(suffix(a.elements) for a in o.alternatives))
            if new != first.get(o.number):
                first[o.number], grown = new, True

    follow: dict[int, set[str]] = {o.number: set() for o in owners}
    follow[g.root.number].add(EOS)
    grown = True
    while grown:
        grown = False
        for o in owners:
            last = follow[o.number] | (first[o.number] - {EPS} if o.closure else set())
            for a in o.alternatives:
                after: set[str] = {EPS}
                for e in reversed(a.elements):
                    ends = after - {EPS} | (last if EPS in after else set())
                    e.follow = frozenset(ends)
                    mine = own(e)
                    after = mine - {EPS} | after if EPS in mine else set(mine)
                    e.first = frozenset(after)
                    key = g.rules[e.name].number if e.kind == "call" else e.number if e.bracket else None
                    if key is not None and not ends <= follow[key]:
                        follow[key] |= ends
                        grown = True
    for o in owners:
        if isinstance(o, Rule):
            o.first, o.follow = frozenset(first[o.number]), frozenset(follow[o.number])
        for a in o.alternatives:
            a.first = frozenset(suffix(a.elements))
    _exclusions(g, owners, own)


def _exclusions(g: Grammar, owners: list[Owner], own) -> None:
    """What every way into a place excludes: the greatest fixpoint, shrinking from all excluding terminals."""
    every = {e.name for e in g.elements if e.kind == "term" and e.exclude}
    if not every:
        return
    top = frozenset(x for e in g.elements if e.kind == "term" for x in e.exclude) | every
    now: dict[int, frozenset[str]] = {o.number: top for o in owners}

    def of(e: Element) -> frozenset[str]:
        if e.kind == "term":
            return frozenset(e.exclude)
        return now[g.rules[e.name].number if e.kind == "call" else e.number]

    def along(elements: list[Element]) -> frozenset[str]:
        found: frozenset[str] | None = None
        for e in elements:
            mine = own(e)
            if mine & every and e.kind not in ("eps", "gap"):
                found = of(e) if found is None else found & (of(e) or found)
            if EPS not in mine:
                break
        return found or frozenset()

    changed = True
    while changed:
        changed = False
        for o in owners:
            ways = [along(a.elements) for a in o.alternatives if a.first & every]
            new = frozenset.intersection(*ways) if ways else frozenset()
            if new != now[o.number]:
                now[o.number], changed = new, True
    for o in owners:
        if isinstance(o, Rule):
            o.exclude = now[o.number]
        for a in o.alternatives:
            a.exclude = along(a.elements) if a.first & every else frozenset()


def conflicts(g: Grammar) -> list[tuple[str, str, str]]:
    """(rule or bracket, kind, token): tokens that two alternatives start with, or one and what follows an empty one;
    and tokens that an optional rule's use may both start and be followed by."""
    out = set()
    for o in [*g.rules.values(), *(e for e in g.elements if e.bracket)]:
        seen: dict[str, int] = {}
        for a in o.alternatives:
            for t in a.first:
                seen[t] = seen.get(t, 0) + 1
        if any(EPS in a.first for a in o.alternatives) or o.kind in ("opt", "star"):
            for t in o.follow:
                seen[t] = seen.get(t, 0) + 1
        out |= {(o.name, "alternatives", t) for t, n in seen.items() if n > 1}
    for e in g.elements:
        if e.kind == "call" and EPS in g.rules[e.name].first:
            out |= {(e.name, "use", t) for t in (g.rules[e.name].first - {EPS}) & e.follow}
    return sorted(out)


def is_ll1(g: Grammar) -> bool:
    return not conflicts(g)


def overlaps(g: Grammar) -> list[tuple[str, str, str]]:
    """(owner, terminal, terminal) in different alternatives that can match the same text: one literal begins with the
    other, a pattern matches a literal's start, or two patterns are the same."""
    out = set()
    for o in [*g.rules.values(), *(e for e in g.elements if e.bracket)]:
        for i, a in enumerate(o.alternatives):
            for b in o.alternatives[i + 1 :]:
                for x in a.first & g.terminals.keys():
                    for y in b.first & g.terminals.keys():
                        s, t = g.terminals[x], g.terminals[y]
                        if s.literal and t.literal:
                            hit = s.source.startswith(t.source) or t.source.startswith(s.source)
                        elif s.literal or t.literal:
                            lit, pat = (s, t) if s.literal else (t, s)
                            hit = not pat.lexical_rule and regex.match(pat.source, lit.source) is not None
                        else:
                            hit = s.source == t.source
                        if hit:
                            out.add((o.name, *sorted((x, y))))
    return sorted(out)


def rule_references(g: Grammar) -> list[tuple[str, str]]:
    return sorted({(r.name, e.name) for r, _, _, e in g.in_rules() if e.kind == "call"})


def first_rows(g: Grammar) -> list[tuple[str, str]]:
    return sorted((r.name, t) for r in g.rules.values() for t in r.first)


def follow_rows(g: Grammar) -> list[tuple[str, str]]:
    return sorted((r.name, t) for r in g.rules.values() for t in r.follow)


__all__ = ["Alternative", "analyse", "conflicts", "first_rows", "follow_rows", "is_ll1", "overlaps", "rule_references"]
