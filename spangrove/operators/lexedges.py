"""Tokens as a relation: every match of every terminal at every place of a text, and the filters over it.

A pattern that looks ahead from each character gives all its matches at once, one for each place and overlapping ones
too, so the relation is made within a text's row by functions of the JVM: no shuffle, no Python. A match is
(t, start, end, after, gap): the terminal, its place, its end, where the trivia behind it ends, and what that gap
holds (0 nothing, 1 something, 2 a line break). Literals that a longer match of a lexical class hides are left out;
a terminal with a split character has a match before each later one of them too.

The size of the relation is that of all matches: a run of n characters that a pattern matches from each of its places
is read n times. Trivia must be patterns; rules as trivia, tokens given by rules and layout tokens need the kernel.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grammar import EOS, EPS, Grammar
from ..plans.kernel import looks_back_ok
from ..sources.scratch import free_name

END = 0
EDGE = "array<struct<t:int,start:int,end:int,after:int,gap:int>>"


def java(source: str) -> str:
    """A pattern of a grammar in Java's notation, to be used behind (?U)."""
    if re.search(r"(?<!\\)(\\\\)*\\[1-9]", source):
        raise ValueError(f"a pattern that refers to its own groups: {source}")
    source = re.sub(r"\\U([0-9A-Fa-f]{8})", lambda m: rf"\x{{{int(m[1], 16):X}}}", source)
    return source.replace(r"\p{XID_Start}", r"\p{javaUnicodeIdentifierStart}").replace(r"\p{XID_Continue}", r"\p{javaUnicodeIdentifierPart}")


def quoted(literal: str) -> str:
    return "".join(c if c.isalnum() else rf"\x{{{ord(c):X}}}" for c in literal)


@dataclass
class Terminals:
    """The terminals of a grammar by number (0 is the end of the text) and what the relation needs of them."""

    g: Grammar

    def __post_init__(self):
        odd = [n for n, t in self.g.terminals.items() if t.lexical_rule] + [r.name for r in self.g.rules.values() if r.trivia] + ([">>|"] if self.g.layout else [])
        if odd:
            raise ValueError(f"not a relation of patterns: {', '.join(odd)}")

    @cached_property
    def visible(self) -> list[str]:
        return [n for n, t in self.g.terminals.items() if not t.skip or t.literal]

    @cached_property
    def number(self) -> dict[str, int]:
        return {EOS: END} | {n: i for i, n in enumerate(self.visible, 1)}

    def source(self, name: str) -> str:
        t = self.g.terminals[name]
        return quoted(t.source) if t.literal else java(t.source)

    @cached_property
    def trivia(self) -> str:
        parts = [f"(?>{self.source(n)})" for n, t in self.g.terminals.items() if t.skip]
        return f"(?:{'|'.join(parts)})*+" if parts else ""

    def numbers(self, names) -> list[int]:
        return sorted(self.number[n] for n in names if n != EPS and n in self.number)

    def behind(self, name: str) -> list[int] | None:
        """The terminals that may stand before this one, -1 for none; null where any may."""
        t = self.g.terminals.get(name)
        if not t or not t.behind:
            return None
        return [i for n, i in {"": -1, **self.number}.items() if looks_back_ok(t.behind, n)]


def anchored(text: Column, source: str) -> Column:
    """What the pattern matches at each place of the text, empty where it does not."""
    return F.regexp_extract_all(text, F.lit(f"(?U)(?:(?=({source}))|)(?s:.)"), F.lit(1))


def ends_before(match, t: int, s: Column, i: Column) -> Column:
    return match(t, s, i, False)


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def places(text: Column, terminals: Terminals) -> Column:
    """For each place at which a token may be looked for (the text's start and wherever no trivia begins): the place `at`,
    the gap before the token, and its matches."""
    g, names = terminals.g, terminals.visible
    visible = [n for n in names if not g.terminals[n].skip]
    lens = [F.transform(anchored(text, terminals.source(n)), F.length).alias(f"l{terminals.number[n]}") for n in visible]
    blank = anchored(text, terminals.trivia) if terminals.trivia else F.transform(F.split(text, "(?s)(?!^)(?=.)"), lambda _: F.lit(""))
    raw = F.struct(F.length(text).alias("n"), text.alias("text"), blank.alias("blank"), *lens)
    classes = [n for n in visible if g.terminals[n].lexical_class and not g.terminals[n].literal]

    def found(z: Column, w: Column) -> Column:
        """Matches at a place, of its own row z and what was read off its trivia w."""

        def match(t: int, s: Column, end: Column, trivia: bool = True) -> Column:
            after = end + F.coalesce(F.get(w["skip"], end), F.lit(0)) if trivia else end
            gap = F.coalesce(F.get(w["gap"], end), F.lit(0)) if trivia else F.lit(0)
            return F.struct(F.lit(t).alias("t"), s.alias("start"), end.alias("end"), after.cast("int").alias("after"), gap.alias("gap"))

        def here(p: Column) -> Column:
            s = p + F.coalesce(F.get(w["skip"], p), F.lit(0))
            size = lambda n: F.coalesce(F.get(z[f"l{terminals.number[n]}"], s), F.lit(0))
            parts = []
            for n in visible:
                t, size_n = g.terminals[n], size(n)
                if t.literal:
                    for c in classes:
                        size_n = F.when(size(c) > size(n), F.lit(0)).otherwise(size_n)
                parts.append(F.when(size_n > 0, match(terminals.number[n], s, s + size_n)))
            every = F.filter(F.array(*parts, F.when(s == z["n"], match(END, s, s, False))), lambda x: x.isNotNull())
            for n in visible:
                split = g.terminals[n].split_before
                if split:
                    inner = F.when(size(n) > 1, F.filter(F.sequence(s + 1, s + size(n) - 1), lambda i: z["text"].substr(i + 1, F.lit(1)) == split)).otherwise(F.array().cast("array<int>"))
                    every = F.concat(every, F.transform(inner, partial(ends_before, match, terminals.number[n], s)))
            gap = F.coalesce(F.get(w["gap"], p), F.lit(0))
            return F.struct(p.alias("at"), gap.alias("gap"), every.cast(EDGE).alias("edges"))

        splits = any(g.terminals[n].split_before for n in visible)  # a split match may end before trivia
        some = F.filter(F.sequence(F.lit(0), z["n"]), lambda p: F.lit(splits) | (p == 0) | (F.coalesce(F.get(w["skip"], p), F.lit(0)) == 0))
        return F.transform(some, here)

    def with_trivia(z: Column) -> Column:
        skip = F.transform(z["blank"], F.length)
        gap = F.transform(z["blank"], lambda b: F.when(b.rlike("[\\n\\r]"), F.lit(2)).when(F.length(b) > 0, F.lit(1)).otherwise(F.lit(0)))
        return _once(F.struct(skip.alias("skip"), gap.alias("gap")), lambda w: found(z, w))

    return _once(raw, with_trivia)


def lex_places(df: DataFrame, ids: list[str], text_col: str, terminals: Terminals) -> DataFrame:
    """ids, at, gap, edges, n: a row for each place of each text. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*ids, F.length(text).alias("n"), F.explode(places(text, terminals)).alias("x"))
    return rows.select(*ids, "n", "x.at", "x.gap", "x.edges")


def lex_edges(df: DataFrame, ids: list[str], text_col: str, terminals: Terminals) -> DataFrame:
    """ids, start, t, end, after, gap: all matches at places where no trivia begins, the end of the text (t = 0) among them."""
    rows = lex_places(df, ids, text_col, terminals).select(*ids, "at", F.explode("edges").alias("e"))
    # Behind trivia at the text's start the matches of the first token stand at their own place, too.
    return rows.where("at = e.start").select(*ids, "e.start", "e.t", "e.end", "e.after", "e.gap")


# Filters, in the order in which they apply. Each takes and gives all edges with a flag `alive`, since a filter asks for
# what matches at a place, not for what is left of it; what stands at one place meets in windows over the texts' ids and
# places, so a partitioning on the ids lasts through all of them.


def by_place(edges: DataFrame, ids: list[str], led: Column, what: Column, name: str) -> DataFrame:
    """edges with the set of `what` (of other edges) that stand where this edge has `led`: a semi-join of the edges with
    themselves as one window over both roles, the one who asks and the one who answers."""
    place, asks = free_name(edges, "place"), free_name(edges, "asks")
    answer = F.col("after") if name == "before" else F.col("start")
    roles = F.array(F.struct(led.alias("at"), F.lit(True).alias("asks")), F.struct(answer.alias("at"), F.lit(False).alias("asks")))
    rows = edges.withColumn(place, F.explode(roles)).withColumn(asks, F.col(f"{place}.asks")).withColumn(place, F.col(f"{place}.at"))
    met = F.array_sort(F.collect_set(F.when(~F.col(asks), what)).over(Window.partitionBy(*ids, place)))
    return rows.withColumn(name, met).where(asks).drop(place, asks)


def with_before(edges: DataFrame, ids: list[str]) -> DataFrame:
    """edges, all alive, with `before`: the terminals that lead to their start, -1 where none does."""
    led = by_place(edges, ids, F.col("start"), F.col("t"), "before")
    return led.withColumn("before", F.when(F.size("before") == 0, F.array(F.lit(-1))).otherwise(F.col("before"))).withColumn("alive", F.lit(True))


def lookbehind(edges: DataFrame, ids: list[str], terminals: Terminals) -> DataFrame:
    """Alive stay those whose terminal may stand behind one of those that lead to it; of a split one the longest match."""
    allowed, split = F.lit(None).cast("array<int>"), F.lit(False)
    for n, i in terminals.number.items():
        some = terminals.behind(n)
        if some is not None:
            allowed = F.when(F.col("t") == i, numbers(some)).otherwise(allowed)
            if terminals.g.terminals[n].split_before:
                split = F.when(F.col("t") == i, F.lit(True)).otherwise(split)
    longest = F.col("end") == F.max("end").over(Window.partitionBy(*ids, "start", "t"))
    ok = allowed.isNull() | F.arrays_overlap(allowed, "before") | (split & longest)
    return edges.withColumn("alive", F.col("alive") & ok)


def exclude(edges: DataFrame, ids: list[str], excluded: dict[int, list[int]]) -> DataFrame:
    """Alive stay those at whose place no excluded terminal matches with the same end: an anti-join on place and end."""
    there, taken = F.collect_set("t").over(Window.partitionBy(*ids, "start", "after")), F.lit(False)
    for t, others in excluded.items():
        taken = F.when(F.col("t") == t, F.arrays_overlap(there, numbers(o for o in others if o != t))).otherwise(taken)
    return edges.withColumn("alive", F.col("alive") & ~taken)


def ahead(edges: DataFrame, ids: list[str], wanted: dict[int, list[int]], keep: bool) -> DataFrame:
    """Alive stay those behind which one of the wanted terminals matches (keep), or none of them does; terminals that are
    not named stay, as does what ends the text."""
    seen = free_name(edges, "seen")
    rows, ok = by_place(edges, ids, F.col("after"), F.col("t"), seen), F.lit(True)
    for t, some in wanted.items():
        met = F.arrays_overlap(F.col(seen), numbers(some))
        ok = F.when(F.col("t") == t, (met if keep else ~met) | F.array_contains(seen, END)).otherwise(ok)
    return rows.withColumn("alive", F.col("alive") & ok).drop(seen)


def distinct_ends(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Of what is alive, one candidate for each terminal, place and end of its trivia: the longest."""
    return edges.where("alive").groupBy(*ids, "start", "t", "after").agg(F.max("end").alias("end"))


def numbers(some) -> Column:
    return F.array(*map(F.lit, some)).cast("array<int>")
