"""Tokens as a relation of runs, for grammars whose terminals are literals and repeated classes of characters.

Inside a run of such a class every place has a match, and all of them end alike. So a run is one row where `lex_edges`
has a row for each place: terminal t matches at each of the `places` places from `start` on, up to `end`. What a batch of
texts holds is read off an array of its code points by numpy, without a step for each character; Spark deals out the
texts and does all that follows. Other grammars get the rows of `lex_edges` with one place each.

With cut=True runs are cut so that all places of a row are alike for the filters: the same runs hold them, and where an edge
leads to a place, that place has rows of its own. A filter then treats a row as the edge at its start.

A filter asks what stands at a row's place, leads to it or stands behind it, of all edges of the text and whatever other
filters left. `lex_sets` gives each row these sets as bits of a number, read off the same arrays, so that the filters
(`behind`, `exclude`, `ahead`) are conditions on a row: no shuffle, no sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexedges import END, Terminals, by_place, lex_edges, lex_places, numbers

FIELDS = ["start", "places", "t", "end", "after", "gap"]
RUN = ",".join(f"{n}:int" for n in FIELDS)
#: before, same, next: the terminals that lead to a row's start, that match there with the same `after`, and that match at
#: `after`, as bits; longest: no match of its terminal at its place has a later end.
SETS = ["before", "same", "next", "longest"]
SET = "before:bigint,same:bigint,next:bigint,longest:boolean"
#: Code points that are read at once; a longer text is read alone.
MOST = 1 << 20
#: Stands between texts; no code point.
BREAK = 0x110000
_CLASS = re.compile(r"(\[\^?(?:\\.|[^\]\\\[])+\]|\\[dwsDWS]|\\[^\w\s]|[^\w\s\\\[\](){}.*+?|^$#])(\+?)")


def _class(t) -> tuple[str, bool] | None:
    """The class of characters that a terminal has one of, and whether it repeats it."""
    if t.literal:
        return (regex.escape(t.source), False) if len(t.source) == 1 else None
    m = _CLASS.fullmatch(t.source)
    return (m[1], bool(m[2])) if m else None


def spans_of(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of what is true begin and end."""
    at = np.flatnonzero(np.diff(member.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return at[0::2], at[1::2]


class Scanner:
    """The runs of texts. Made from plain values, since it travels with the task."""

    def __init__(self, terminals: Terminals):
        g = terminals.g
        names = [n for n in terminals.visible if not g.terminals[n].skip]
        self.runs = [(terminals.number[n], _class(g.terminals[n]), g.terminals[n].split_before, g.terminals[n].lexical_class) for n in names if not g.terminals[n].literal]
        self.literals = [(terminals.number[n], g.terminals[n].source) for n in names if g.terminals[n].literal and g.terminals[n].source]
        self.trivia = [_class(t) for t in g.terminals.values() if t.skip]
        self.whole = all(c for _, c, _, _ in self.runs) and all(self.trivia)
        self.splits = [t for t, _, split, _ in self.runs if split]
        self.tables = None

    def members(self, codes: np.ndarray) -> list[np.ndarray]:
        """For the trivia and each class, which places hold one of its characters."""
        if self.tables is None:
            self.tests = [regex.compile("|".join(c for c, _ in self.trivia))] if self.trivia else [None]
            self.tests += [regex.compile(c) for _, (c, _), _, _ in self.runs]
            self.known = np.zeros(BREAK + 1, bool)
            self.known[BREAK] = True
            self.tables = [np.zeros(BREAK + 1, bool) for _ in self.tests]
        for x in np.unique(codes[~self.known[codes]]).tolist():
            self.known[x] = True
            for table, test in zip(self.tables, self.tests, strict=True):
                table[x] = test is not None and test.fullmatch(chr(x)) is not None
        return [table[codes] for table in self.tables]

    def scan(self, texts: list[bytes], cut: bool, sets: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each text's runs begin among all, and the columns of the runs; with sets, which need cut runs, theirs too."""
        wide = [t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass") for t in texts]
        stop = BREAK.to_bytes(4, "little")
        codes = np.frombuffer(stop.join(wide) + stop, np.uint32)
        sizes = np.array([len(w) // 4 for w in wide], np.int64)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        blank, *members = self.members(codes)
        skip = np.zeros(len(codes) + 1, np.int64)
        for_from, for_to = spans_of(blank)
        width = for_to - for_from
        skip[:-1][blank] = np.repeat(for_to, width) - np.flatnonzero(blank)
        breaks = np.concatenate([[0], np.cumsum((codes == 10) | (codes == 13))])

        rows: list[tuple[np.ndarray, ...]] = []

        def add(t: int, start: np.ndarray, places: np.ndarray, end: np.ndarray, trivia: bool = True) -> None:
            after = end + skip[end] if trivia else end
            gap = np.where(after == end, 0, np.where(breaks[after] > breaks[end], 2, 1))
            rows.append((start, places, np.full(len(start), t), end, after, gap))

        classes = []
        for (t, (_, repeated), split, lexical), member in zip(self.runs, members, strict=True):
            begin, end = spans_of(member) if repeated else (np.flatnonzero(member), np.flatnonzero(member) + 1)
            if lexical:
                classes.append((begin, end))
            a, b = spans_of(member & ~blank) if repeated else (begin[~blank[begin]], end[~blank[begin]])  # no match begins at trivia
            e = end[np.searchsorted(begin, a, "right") - 1]
            add(t, a, b - a, e)
            if split and len(split) == 1:
                at = np.flatnonzero(member & (codes == ord(split)))
                low, high = np.searchsorted(at, a, "right"), np.searchsorted(at, e, "left")
                which = np.repeat(np.arange(len(a)), high - low)
                i = at[np.arange(len(which)) + np.repeat(high - np.cumsum(high - low), high - low)]
                add(t, a[which], np.minimum(b[which], i) - a[which], i, False)
        for t, source in self.literals:
            size = len(source)
            here = np.ones(max(len(codes) - size + 1, 0), bool)
            for k, c in enumerate(source):
                here &= codes[k : len(here) + k] == ord(c)
            p = np.flatnonzero(here & ~blank[: len(here)])
            for begin, end in classes:
                if len(begin):
                    run = end[np.maximum(np.searchsorted(begin, p, "right") - 1, 0)]
                    p = p[(run - p <= size) | (begin[0] > p)]
            add(t, p, np.ones(len(p), np.int64), p + size)
        add(END, firsts + sizes, np.ones(len(texts), np.int64), firsts + sizes, False)

        columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
        if cut:
            columns = cut_up(columns, len(codes) + 2)
        if sets:
            columns += sets_of(columns, len(codes) + 2, self.splits)
        text = np.searchsorted(firsts, columns[0], "right") - 1
        order = np.argsort(text, kind="stable")
        text = text[order]
        columns = [c[order] for c in columns]
        for k in (0, 3, 4):
            columns[k] = columns[k] - firsts[text]
        return np.searchsorted(text, np.arange(len(texts) + 1)), columns


def cut_up(columns: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The runs cut at each other's starts and ends, and before and behind each place that one leads to."""
    start, places, _, _, after, _ = columns
    mark = np.zeros(n, bool)
    for at in (start, start + places, after, after + 1):
        mark[at] = True
    cuts, nth = np.flatnonzero(mark), np.cumsum(mark) - 1
    low, pieces = nth[start], nth[start + places] - nth[start]
    row = np.repeat(np.arange(len(start)), pieces)
    at = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + low[row]
    return [cuts[at], cuts[at + 1] - cuts[at], *(c[row] for c in columns[2:])]


def sets_of(columns: list[np.ndarray], n: int, splits: list[int]) -> list[np.ndarray]:
    """SETS of cut runs, in which those that hold a place begin alike; splits: the terminals with several ends at a place."""
    start, _, t, end, after, _ = columns
    here, led, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(len(t), bool)
    for k in range(int(t.max()) + 1):
        mine = np.flatnonzero(t == k)
        here[start[mine]] |= 1 << k
        led[after[mine]] |= 1 << k
        if k in splits:
            last = np.zeros(n, np.int64)
            np.maximum.at(last, start[mine], end[mine])
            longest[mine] = end[mine] == last[start[mine]]
    same = np.int64(1) << t
    several = np.flatnonzero(here[start] != same)
    if len(several):
        key = start[several] * n + after[several]
        several = several[np.argsort(key)]
        key = start[several] * n + after[several]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        same[several] = np.repeat(np.bitwise_or.reduceat(same[several], first), np.diff(first, append=len(key)))
    return [led[start], same, here[after], longest]


def _scanned(scanner: Scanner, cut: bool, sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, begin = np.cumsum(batch.column("text_").cast(pa.binary()).fill_null(b"").to_pandas().str.len().to_numpy(np.int64)), 0
            while begin < batch.num_rows:
                before = sizes[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + MOST, "right")))
                part = batch.slice(begin, end - begin)
                texts = [x or b"" for x in part.column("text_").cast(pa.binary()).to_pylist()]
                offsets, columns = scanner.scan(texts, cut, sets)
                columns[:6] = [c.astype(np.int32) for c in columns[:6]]
                runs = pa.StructArray.from_arrays([pa.array(c) for c in columns], FIELDS + SETS if sets else FIELDS)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[:-1]), lists], [*part.schema.names[:-1], "runs_"])
                begin = end

    return run


def _runs(df: DataFrame, ids: list[str], text_col: str, scanner: Scanner, cut: bool, sets: bool) -> DataFrame:
    """ids, runs_: the runs of each text as one array."""
    keys = [f"id{k}_" for k in range(len(ids))]
    rows = df.select(*(F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)), F.col(text_col).alias("text_"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(_scanned(scanner, cut, sets), f"{schema}, runs_ array<struct<{f'{RUN},{SET}' if sets else RUN}>>")
    return found.select(*(F.col(k).alias(i) for i, k in zip(ids, keys, strict=True)), "runs_")


def lex_runs(df: DataFrame, ids: list[str], text_col: str, terminals: Terminals, cut: bool = False, by: str | None = None) -> DataFrame:
    """ids, start, places, t, end, after, gap: the matches of `lex_edges`, those that stand side by side and end alike in one
    row. A null text is empty. by: the id that deals out the rows, while a text's runs are still one row."""
    scanner = Scanner(terminals)
    if not scanner.whole:
        edges = lex_edges(df.repartition(by) if by else df, ids, text_col, terminals)
        return edges.select(*ids, "start", F.lit(1).alias("places"), "t", "end", "after", "gap")
    named = _runs(df, ids, text_col, scanner, cut, False)
    return (named.repartition(by) if by else named).select(*ids, F.inline("runs_"))


def lex_sets(df: DataFrame, ids: list[str], text_col: str, terminals: Terminals, shared: bool = False) -> DataFrame:
    """The cut runs of `lex_runs` with their SETS. shared: several texts may have the same ids; a filter then asks the edges
    of all of them (of none where an id is null, which equals nothing), but each ends at its own end."""
    if max(terminals.number.values()) > 62:
        raise ValueError("more than 62 terminals do not fit in a number: use the filters of lexedges")
    scanner = Scanner(terminals)
    if scanner.whole and not shared:
        return _runs(df, ids, text_col, scanner, True, True).select(*ids, F.inline("runs_"))
    rows = lex_places(df, ids, text_col, terminals).select(*ids, "n", "at", F.explode("edges").alias("e")).where("at = e.start")
    rows = rows.select(*ids, "n", "e.*").withColumn("places", F.lit(1))
    rows = by_place(by_place(rows, ids, F.col("start"), F.col("t"), "before"), ids, F.col("after"), F.col("t"), "next")
    rows = rows.withColumn("same", F.collect_set("t").over(Window.partitionBy(*ids, "start", "after")))
    if shared:
        known = reduce(lambda a, b: a & b, (F.col(i).isNotNull() for i in ids))
        own = F.when(F.col("after") == F.col("n"), F.array(F.lit(END))).otherwise(numbers([]))
        rows = rows.withColumns({c: F.when(known, F.col(c)).otherwise(numbers([])) for c in SETS[:3]})
        rows = rows.withColumn("next", F.concat(F.array_remove("next", END), own))
    one = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t)
    sets = [F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(one(t))).alias(c) for c in SETS[:3]]
    longest = F.col("end") == F.max("end").over(Window.partitionBy(*ids, "start", "t"))
    return rows.select(*ids, *FIELDS, *sets, longest.alias("longest"))


def one_end(ids: list[str], alive: str) -> Column:
    """Whether a row is the longest of those alive with its terminal, place and `after`, once. In one text no two rows share
    these: a split match ends where its `after` is, before any other match of its terminal; so texts with ids of their own
    need no such step."""
    return F.row_number().over(Window.partitionBy(*ids, "start", "t", "after").orderBy(F.desc(alive), F.desc("end"))) == 1


def _any(of: str, some: Iterable[int]) -> Column:
    """Whether one of the terminals is in a set."""
    return F.col(of).bitwiseAND(F.lit(sum(1 << n for n in set(some))).cast("long")) != 0


# The filters of lexedges as conditions on the rows of `lex_sets`.


def behind(terminals: Terminals) -> Column:
    """Whether a row's terminal may stand behind one of those that lead to it; of a split one the longest match may."""
    ok = F.lit(True)
    for n, i in terminals.number.items():
        some = terminals.behind(n)
        if some is not None:
            met = _any("before", (x for x in some if x >= 0))
            if -1 in some:
                met |= F.col("before") == 0
            if terminals.g.terminals[n].split_before:
                met |= F.col("longest")
            ok = F.when(F.col("t") == i, met).otherwise(ok)
    return ok


def exclude(excluded: dict[int, list[int]]) -> Column:
    """Whether no excluded terminal matches at a row's place with the same `after`."""
    ok = F.lit(True)
    for t, others in excluded.items():
        ok = F.when(F.col("t") == t, ~_any("same", (o for o in others if o != t))).otherwise(ok)
    return ok


def ahead(wanted: dict[int, list[int]], keep: bool) -> Column:
    """Whether one of the wanted terminals matches behind a row (keep), or none does, or the text ends there."""
    ok = F.lit(True)
    for t, some in wanted.items():
        met = _any("next", some)
        ok = F.when(F.col("t") == t, (met if keep else ~met) | _any("next", [END])).otherwise(ok)
    return ok
