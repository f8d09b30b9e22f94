"""Everything after the parse of one message: disambiguation, shared forest, trees and diagnostics.

All of it reads the spans (element, i, k, j) as edges. An alternative over [i, j] is a chain of spans of its elements,
each pivot the end of the one before; a call or bracket span leads on to its own alternatives over [k, j]; a closure
over [k, j] is a chain of iterations.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from .grammar import Alternative, Element, Grammar, Rule
from .kernel import Parse

Owner = Rule | Element


class Forest:
    """Lookups over the spans of a parse."""

    def __init__(self, parse: Parse):
        self.parse, self.g, self.text = parse, parse.grammar, parse.text
        self.spans = parse.spans

    @cached_property
    def by_start(self) -> dict[tuple[int, int, int], list[int]]:
        """(element, i, k) -> ends."""
        out: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for number, found in self.spans.items():
            for i, k, j in found:
                out[number, i, k].append(j)
        for x in out.values():
            x.sort()
        return out

    @cached_property
    def owner_ends(self) -> dict[tuple[int, int], list[int]]:
        """(owner, start) -> ends of one use of it; of one iteration for a closure."""
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        for o in [*self.g.rules.values(), *(e for e in self.g.elements if e.bracket)]:
            for a in o.alternatives:
                last = a.elements[-1]
                for i, _, j in self.spans.get(last.number, ()):
                    if (i, j) not in out or j not in out[o.number, i]:
                        out[o.number, i].add(j)
        own = {o.number for o in self.g.rules.values()}
        return {k: sorted(j for j in v if k[0] not in own or (k[1], k[1], j) in self.spans.get(k[0], ())) for k, v in out.items()}

    def target(self, e: Element) -> Owner | None:
        return self.g.rules[e.name] if e.kind == "call" else e if e.bracket else None

    @cached_property
    def by_end(self) -> dict[tuple[int, int, int], list[int]]:
        """(element, i, j) -> pivots."""
        out: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for number, found in self.spans.items():
            for i, k, j in found:
                out[number, i, j].append(k)
        return out

    def chains(self, a: Alternative, i: int, j: int) -> bool:
        return i in self._steps(a, i, j)[0]

    def _tiles(self, a: Alternative, p: int, i: int, k: int, j: int) -> list[int]:
        """The ends of element p from k from which the rest of the alternative reaches j."""
        return self._steps(a, i, j)[p].get(k, [])

    def _steps(self, a: Alternative, i: int, j: int) -> list[dict[int, list[int]]]:
        """For each element, from which pivot to which ends it goes on whole tilings; found from the end back, so spans
        that lead elsewhere are not looked at."""
        memo = self._memo
        key = a.number, i, j
        if key not in memo:
            steps: list[dict[int, list[int]]] = []
            goals = [j]
            for e in reversed(a.elements):
                own = self.spans.get(self.g.rules[e.name].number, ()) if e.kind == "call" else None
                step: dict[int, list[int]] = {}
                for m in goals:
                    for k in self.by_end.get((e.number, i, m), ()):
                        # A use of a rule and the rule itself must both have the stretch.
                        if own is None or (k, k, m) in own:
                            step.setdefault(k, []).append(m)
                for ends in step.values():
                    ends.sort()
                steps.append(step)
                goals = sorted(step)
            memo[key] = steps[::-1]
        return memo[key]

    @cached_property
    def _memo(self) -> dict[tuple[int, int, int], list[dict[int, list[int]]]]:
        return {}

    def iterations(self, e: Element, k: int, j: int) -> list[int]:
        """The ends of first iterations from k from which further iterations reach j exactly."""
        reach = self._iteration_reach(e, j)
        return [m for m in self.owner_ends.get((e.number, k), ()) if k < m <= j and (m == j or m in reach)]

    def _iteration_reach(self, e: Element, j: int) -> set[int]:
        key = e.number, j
        if key not in self._reach:
            back: dict[int, list[int]] = defaultdict(list)
            for (number, s), ends in self.owner_ends.items():
                if number == e.number:
                    for m in ends:
                        if m > s:
                            back[m].append(s)
            got, todo = set(), [j]
            while todo:
                for s in back.get(todo.pop(), ()):
                    if s not in got:
                        got.add(s)
                        todo.append(s)
            self._reach[key] = got
        return self._reach[key]

    @cached_property
    def _reach(self) -> dict[tuple[int, int], set[int]]:
        return {}


def prune_unproductive(parse: Parse, to: int, all_alive: bool = False) -> int:
    """Keep the spans that some whole derivation of the root over [start, to] uses; the number that went.

    First the spans that nothing finite derives go (a least fixpoint from below; all_alive says there are none, as
    right after a parse), then those that the root does not lead to. What is left is whole derivations, so once is enough.
    """
    gone = 0
    if not all_alive:
        alive = _derivable(parse)
        gone = sum(len(x) - len(alive[n]) for n, x in parse.spans.items())
        if gone:
            parse.spans = {n: x for n, x in alive.items() if x}
    keep = _reachable(parse, to)
    gone += sum(len(x) - len(x & keep.get(n, set())) for n, x in parse.spans.items())
    parse.spans = {n: x & keep[n] for n, x in parse.spans.items() if n in keep and x & keep[n]}
    return gone


def _reachable(parse: Parse, to: int) -> dict[int, set[tuple[int, int, int]]]:
    """The spans of all whole alternatives that the root leads to, and of the owners themselves."""
    f, g = Forest(parse), parse.grammar
    keep: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    todo: list[tuple[Owner, int, int]] = [(parse.root, parse.start, to)]
    visited = set()
    while todo:
        owner, i, j = todo.pop()
        if (owner.number, i, j) in visited or (i, i, j) not in parse.spans.get(owner.number, ()) and isinstance(owner, Rule):
            continue
        visited.add((owner.number, i, j))
        if (i, i, j) in parse.spans.get(owner.number, ()):
            keep[owner.number].add((i, i, j))
        for a in owner.alternatives:
            starts = {i} if f.chains(a, i, j) else set()
            for p, e in enumerate(a.elements):
                ends = set()
                for k in starts:
                    for m in f._tiles(a, p, i, k, j):
                        ends.add(m)
                        keep[e.number].add((i, k, m))
                        if e.kind == "call":
                            todo.append((g.rules[e.name], k, m))
                        elif e.closure:
                            todo += _iteration_spans(f, e, k, m)
                        elif e.bracket and not (k == m and e.kind == "opt"):
                            todo.append((e, k, m))
                starts = ends
    return keep


def _iteration_spans(f: Forest, e: Element, k: int, j: int) -> list[tuple[Owner, int, int]]:
    out, todo, seen = [], [k], set()
    while todo:
        s = todo.pop()
        if s in seen or s == j and s != k:
            continue
        seen.add(s)
        for m in f.iterations(e, s, j) if s < j else f.owner_ends.get((e.number, s), ()):
            if m <= j:
                out.append((e, s, m))
                todo.append(m)
    return out


def _derivable(parse: Parse) -> dict[int, set[tuple[int, int, int]]]:
    """Spans whose callee has an alternative over the same stretch that ends in a finite derivation."""
    g = parse.grammar
    whole: set[tuple[int, int, int]] = set()
    alive: dict[int, set[tuple[int, int, int]]] = {n: set() for n in parse.spans}
    changed = True
    while changed:
        changed = False
        reach: dict[tuple[int, int], set[int]] = defaultdict(set)
        for number, s, m in whole:
            reach[number, s].add(m)
        for e in g.elements:
            for i, k, j in parse.spans.get(e.number, ()):
                if (i, k, j) in alive[e.number]:
                    continue
                if e.kind in ("term", "eps", "gap") or e.kind in ("opt", "star") and k == j:
                    ok = True
                elif e.kind == "call":
                    ok = (g.rules[e.name].number, k, j) in whole
                elif e.closure:
                    seen, todo = set(), [k]
                    while todo:
                        for m in reach.get((e.number, todo.pop()), ()):
                            if m not in seen:
                                seen.add(m)
                                todo.append(m)
                    ok = j in seen
                else:
                    ok = (e.number, k, j) in whole
                if ok:
                    alive[e.number].add((i, k, j))
                    changed = True
        for o in [*g.rules.values(), *(e for e in g.elements if e.bracket)]:
            for a in o.alternatives:
                front = {(i, i) for e in a.elements[:1] for i, k, _ in alive.get(e.number, ()) if i == k}
                for e in a.elements:
                    step: dict[tuple[int, int], set[int]] = defaultdict(set)
                    for i, k, j in alive.get(e.number, ()):
                        step[i, k].add(j)
                    front = {(i, j) for i, k in front for j in step.get((i, k), ())}
                for i, j in front:
                    if (o.number, i, j) not in whole and (not isinstance(o, Rule) or (i, i, j) in parse.spans.get(o.number, ())):
                        whole.add((o.number, i, j))
                        changed = True
    for r in g.rules.values():
        if r.number in alive:
            alive[r.number] |= {(i, k, j) for i, k, j in parse.spans[r.number] if (r.number, i, j) in whole}
    for e in g.elements:
        if e.bracket and e.number in alive:
            alive[e.number] |= {(i, k, j) for i, k, j in parse.spans[e.number] if i == k and (e.number, i, j) in whole}
    return alive


@dataclass(frozen=True)
class Choice:
    """One disambiguation rule: which spans of `number` stay. kind: longest, shortest, left, right, prefer, avoid."""

    kind: str
    number: int
    preferred: tuple[int, ...] = ()


def choices(g: Grammar) -> list[Choice]:
    """The grammar's rules in a fixed order: by kind, then by number."""
    if g.choices is None:
        g.choices = _choices(g)
    return g.choices


def _choices(g: Grammar) -> list[Choice]:
    out = set()
    for r in g.rules.values():
        if r.choice in ("longest", "shortest"):
            out.add(Choice(r.choice, r.number))
        elif r.choice:
            out |= {Choice(r.choice, e.number) for a in r.alternatives for e in a.elements}
        best = tuple(a.elements[-1].number for a in r.alternatives if a.prefer)
        if best:
            out |= {Choice("prefer", a.elements[-1].number, best) for a in r.alternatives if not a.prefer}
    for _, a, p, e in g.in_rules():
        if e.avoid and p + 1 < len(a.elements):
            out.add(Choice("avoid", a.elements[p + 1].number))
    order = ["longest", "shortest", "left", "right", "prefer", "avoid"]
    return sorted(out, key=lambda c: (order.index(c.kind), c.number))


def apply(choice: Choice, spans: dict[int, set[tuple[int, int, int]]]) -> int:
    """Drop what the rule rejects; the number that went."""
    mine = spans.get(choice.number, set())
    if choice.kind == "prefer":
        taken = {(i, j) for n in choice.preferred for i, _, j in spans.get(n, ())}
        drop = {(i, k, j) for i, k, j in mine if (i, j) in taken}
    else:
        extent = choice.kind in ("longest", "shortest")
        pick = max if choice.kind in ("longest", "left") else min
        groups: dict[tuple, list[int]] = defaultdict(list)
        for i, k, j in mine:
            groups[(i,) if extent else (i, j)].append(j if extent else k)
        best = {key: pick(x) for key, x in groups.items()}
        drop = {(i, k, j) for i, k, j in mine if (j != best[i,] if extent else k != best[i, j])}
    if drop:
        spans[choice.number] = mine - drop
    return len(drop)


def disambiguate(parse: Parse) -> int:
    """Prune, apply the rules until nothing changes, prune again; nothing unless the root covers the text exactly."""
    if not parse.exact:
        return 0
    gone = prune_unproductive(parse, len(parse.text), all_alive=True)
    chosen = 0
    while dropped := sum(apply(c, parse.spans) for c in choices(parse.grammar)):
        chosen += dropped
    return gone + chosen + (prune_unproductive(parse, len(parse.text)) if chosen else 0)


@dataclass
class Tree:
    name: str
    start: int
    end: int
    image: str | None = None
    children: list[Tree] = field(default_factory=list)
    ambiguous: bool = False
    missing: bool = False

    def dump(self, depth: int = 0) -> str:
        out, todo = [], [(self, depth)]
        while todo:
            t, d = todo.pop()
            shown = "" if t.image is None else f" {t.image!r}"
            out.append(f"{'  ' * d}{t.name} [{t.start}..{t.end}]{shown}{' ?' * t.ambiguous}{' !' * t.missing}")
            todo += [(c, d + 1) for c in reversed(t.children)]
        return "\n".join(out)

    def rows(self) -> Iterator[tuple[int, int | None, int, str, int, int, str | None, bool]]:
        """(id, parent, place among siblings, name, start, end, image, ambiguous), parents first."""
        todo: deque[tuple[Tree, int | None, int]] = deque([(self, None, 0)])
        number = 0
        while todo:
            t, parent, place = todo.popleft()
            yield number, parent, place, t.name, t.start, t.end, t.image, t.ambiguous
            todo += [(c, number, p) for p, c in enumerate(t.children)]
            number += 1


@dataclass(frozen=True)
class Diagnostic:
    node: str
    message: str
    start: int
    end: int
    candidates: int
    signature: str


class Trees:
    def __init__(self, parse: Parse):
        self.f, self.parse, self.g = Forest(parse), parse, parse.grammar
        self.open: set[tuple[int, int, int]] = set()
        self.diagnostics: list[Diagnostic] = []
        self.longest: dict[int, tuple[str, int, int, int, int]] = {}
        for c in parse.commits:
            if c[1] not in self.longest or c[3] > self.longest[c[1]][3]:
                self.longest[c[1]] = c

    def image(self, k: int, j: int) -> str:
        c = self.longest.get(k)
        return self.parse.text[k : min(c[3], j)] if c else self.parse.text[k:j]

    def leaf(self, e: Element, k: int, j: int) -> Tree:
        return Tree(e.name, k, j, "" if e.kind == "gap" else self.image(k, j))

    # All trees, brackets left out.

    def every(self, limit: int = 10) -> list[Tree]:
        if not self.parse.exact:
            return []
        return self._rule(self.parse.root, self.parse.start, len(self.parse.text), limit)

    def _rule(self, r: Rule, i: int, j: int, limit: int) -> list[Tree]:
        key = r.number, i, j
        if key in self.open:
            return []
        self.open.add(key)
        bodies = self._bodies(r, i, j, limit)
        self.open.discard(key)
        unlike = len({tuple((c.name, c.start, c.end) for c in b) for b in bodies}) > 1
        return [Tree(r.name, i, j, None, b, unlike) for b in bodies]

    def _bodies(self, o: Owner, i: int, j: int, limit: int) -> list[list[Tree]]:
        out: list[list[Tree]] = []
        for a in o.alternatives:
            if len(out) < limit and self.f.chains(a, i, j):
                out += self._body(a, 0, i, i, j, limit - len(out))
        return out[:limit]

    def _body(self, a: Alternative, p: int, i: int, k: int, j: int, limit: int) -> list[list[Tree]]:
        if p == len(a.elements):
            return [[]] if k == j else []
        out: list[list[Tree]] = []
        for m in self.f._tiles(a, p, i, k, j):
            for head in self._element(a.elements[p], k, m, limit):
                for rest in self._body(a, p + 1, i, m, j, limit - len(out)):
                    out.append(head + rest)
                    if len(out) >= limit:
                        return out
        return out

    def _element(self, e: Element, k: int, j: int, limit: int) -> list[list[Tree]]:
        if e.kind == "eps":
            return [[]]
        if e.kind in ("term", "gap"):
            return [[self.leaf(e, k, j)]]
        if e.kind == "call":
            return [[t] for t in self._rule(self.g.rules[e.name], k, j, limit)]
        if k == j:
            return [[]]
        if not e.closure:
            return self._bodies(e, k, j, limit)
        out: list[list[Tree]] = []
        for m in self.f.iterations(e, k, j):
            for head in self._bodies(e, k, m, limit - len(out)):
                for rest in [[]] if m == j else self._element(e, m, j, limit - len(out)):
                    out.append(head + rest)
                    if len(out) >= limit:
                        return out
        return out

    # One tree, brackets as nodes, and what was left to choose.

    def one(self) -> Tree | None:
        self.diagnostics = []
        ends = self.parse.ends()
        return self._one_rule(self.parse.root, self.parse.start, ends[0]) if ends else None

    def _one_rule(self, r: Rule, i: int, j: int) -> Tree:
        key = r.number, i, j
        if key in self.open:
            return Tree(r.name, i, j, missing=True)
        self.open.add(key)
        out = Tree(r.name, i, j, None, self._one_body(r, i, j))
        self.open.discard(key)
        return out

    def _one_body(self, o: Owner, i: int, j: int) -> list[Tree]:
        fits = [a for a in o.alternatives if self.f.chains(a, i, j)]
        if len(fits) > 1:
            bodies = sorted("[" + " ".join(e.name for e in a.elements if e.kind != "eps") + "]" for a in fits)
            self.diagnostics.append(Diagnostic(o.name, "ambiguous alternate", i, j, len(fits), " | ".join(bodies)))
        if not fits:
            return []
        out, k, a = [], i, fits[0]
        for p, e in enumerate(a.elements):
            ways = self.f._tiles(a, p, i, k, j)
            if len(ways) > 1:
                names = " ".join(x.name for x in a.elements[p:] if x.kind != "eps")
                self.diagnostics.append(Diagnostic(e.name, "ambiguous pivot", k, j, len(ways), f"body=[{names}]"))
            m = ways[0]
            if e.kind in ("term", "gap"):
                out.append(self.leaf(e, k, m))
            elif e.kind == "call":
                out.append(self._one_rule(self.g.rules[e.name], k, m))
            elif e.bracket:
                out.append(self._one_bracket(e, k, m))
            k = m
        return out

    def _one_bracket(self, e: Element, k: int, j: int) -> Tree:
        out = Tree(e.name, k, j)
        if k < j and not e.closure:
            out.children = self._one_body(e, k, j)
        while k < j and e.closure:
            ways = self.f.iterations(e, k, j)
            if not ways:
                break
            if len(ways) > 1:
                self.diagnostics.append(Diagnostic(e.name, "ambiguous iteration extent", k, j, len(ways), f"iter={e.name}"))
            out.children += self._one_body(e, k, ways[0])
            k = ways[0]
        return out


def sppf(parse: Parse) -> tuple[list[tuple[str, str, str, int, int]], list[tuple[str, str, int]]]:
    """Nodes (id, kind, label, start, end) and edges (parent, child, place) of the binarised shared forest.

    A symbol node has a packed node for each alternative and last pivot; an intermediate node stands for the part of a
    body before an element; equal nodes are one.
    """
    f, g = Forest(parse), parse.grammar
    nodes: dict[str, tuple[str, str, int, int]] = {}
    edges: set[tuple[str, str, int]] = set()
    if not parse.exact:
        return [], []
    todo: list[tuple[Owner, int, int]] = [(parse.root, parse.start, len(parse.text))]

    def symbol(o: Owner, i: int, j: int) -> str:
        key = f"s{o.number}.{i}.{j}"
        if key not in nodes:
            nodes[key] = ("symbol", o.name, i, j)
            todo.append((o, i, j))
        return key

    def child(e: Element, k: int, j: int) -> str | None:
        t = f.target(e)
        if t is not None and not (k == j and e.kind in ("opt", "star")):
            return symbol(t, k, j)
        if e.kind in ("eps", "gap", "opt", "star"):
            key = f"e{e.number}.{k}"
            nodes[key] = ("epsilon", e.name, k, k)
        else:
            key = f"t{e.number}.{k}.{j}"
            nodes[key] = ("terminal", e.name, k, j)
        return key

    def packs(parent: str, a: Alternative, p: int, i: int, j: int, whole: int) -> None:
        for k in sorted(f.by_end.get((a.elements[p].number, i, j), ())):
            if p and (a.elements[p - 1].number, i, k) not in f.by_end:
                continue
            if not p and k != i:
                continue
            key = f"p{a.number}.{p}.{i}.{k}.{j}"
            nodes[key] = ("packed", f"{a.owner.name}:{p}", i, j)
            edges.add((parent, key, 0))
            edges.add((key, child(a.elements[p], k, j), 1))
            if p:
                mid = f"i{a.number}.{p}.{i}.{k}"
                fresh = mid not in nodes
                nodes[mid] = ("intermediate", f"{a.owner.name}:{p}", i, k)
                edges.add((key, mid, 0))
                if fresh:
                    packs(mid, a, p - 1, i, k, whole)

    nodes[f"s{parse.root.number}.{parse.start}.{len(parse.text)}"] = ("symbol", parse.root.name, parse.start, len(parse.text))
    while todo:
        o, i, j = todo.pop()
        me = f"s{o.number}.{i}.{j}"
        for a in o.alternatives:
            if f.chains(a, i, j):
                packs(me, a, len(a.elements) - 1, i, j, j)
        if o.closure:
            # A closure is its first iteration and the closure after it.
            for m in f.iterations(o, i, j):
                if m < j:
                    key = f"c{o.number}.{i}.{m}.{j}"
                    nodes[key] = ("packed", f"{o.name}:+", i, j)
                    edges |= {(me, key, 0), (key, symbol(o, i, m), 0), (key, symbol(o, m, j), 1)}
    return sorted((k, *v) for k, v in nodes.items()), sorted(edges)


def unambiguous(parse: Parse) -> bool:
    t = Trees(parse)
    t.one()
    return not t.diagnostics
