"""The analyses of many small grammars at once, off arrays: sets of tokens as bits of numbers, rounds over all grammars.

Spark deals the rows of whole grammars to a task; a batch of them is one graph here, whose nodes are rules and places
in alternatives. A round takes what the last one changed, in all grammars together. A grammar's tokens have numbers of
their own, 64 of them to a plane.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.grammar import EOS, EPS

#: Rows that are read at once; whole grammars always.
ROWS = 1 << 18
START, OPTIONAL, CLOSURE = 1, 2, 4
MARKS = 8
#: What each analysis gives for a grammar's ids.
SCHEMAS = {
    "begin": "rule string, token string",
    "alternative": "rule string, alt string, token string",
    "follow": "rule string, token string",
    "conflicts": "rule string, kind string, token string, n long",
    "reached": "rule string",
}


def spread(sets: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """sets, where each src has what its dst have, until nothing changes."""
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    changed = sets != 0
    while (live := changed[dst]).any():
        s, d = src[live], dst[live]
        at = np.flatnonzero(np.diff(s, prepend=-1))
        to = s[at]
        got = np.bitwise_or.reduceat(sets[d], at) | sets[to]
        new = got != sets[to]
        changed[:] = False
        changed[to[new]] = True
        sets[to] = got
    return sets


def encoded(values: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """The arrays as places in a list of all their values; -1 for null."""
    every = pa.concat_arrays([v.cast(pa.large_string()) for v in values]).dictionary_encode()
    codes = every.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(v) for v in values])[:-1]), every.dictionary


class Batch:
    """Whole grammars: for each row its grammar (from 0 on, in order), rule, alt, pos, names (from pos on) and mark."""

    def __init__(self, grammar: np.ndarray, rule: pa.Array, alt: pa.Array, pos: pa.Array, names: pa.ListArray, mark: np.ndarray):
        (rule, flat, (self.eos, self.eps)), self.words = encoded([rule, names.flatten(), pa.array([EOS, EPS])])
        (alt,), self.alts = encoded([alt])
        self.width = len(self.words)
        # Rules, and what only starts or traits name.
        self.heads, head = np.unique(grammar * self.width + rule, return_inverse=True)
        marked = lambda bit: np.bincount(head[mark & bit > 0], minlength=len(self.heads)) > 0
        self.start, self.optional, self.closure = marked(START), marked(OPTIONAL), marked(CLOSURE)
        # A row for each name; a list of none is one that is null.
        size = pc.list_value_length(names).fill_null(0).to_numpy(zero_copy_only=False)
        many = np.where(alt >= 0, np.maximum(size, 1), 0)
        name = np.full(many.sum(), -1)
        name[np.repeat(size > 0, many)] = flat[np.repeat(alt >= 0, size)]
        pos = np.repeat(pos.fill_null(0).to_numpy(zero_copy_only=False) - np.cumsum(many) + many, many) + np.arange(len(name))
        bodies, body = np.unique((head * max(len(self.alts), 1) + alt)[alt >= 0], return_inverse=True)
        self.body_head, self.body_alt = np.divmod(bodies, max(len(self.alts), 1))
        body, head, grammar = np.repeat(body, many[alt >= 0]), np.repeat(head, many), np.repeat(grammar, many)
        order = np.lexsort((name, pos, body))
        body, pos, name, head, grammar = body[order], pos[order], name[order], head[order], grammar[order]
        once = np.ones(len(body), bool)
        once[1:] = (np.diff(body) != 0) | (np.diff(pos) != 0) | (np.diff(name) != 0)
        self.body, self.name, self.head, self.grammar = body[once], name[once], head[once], grammar[once]
        is_rule = np.bincount(self.head, minlength=len(self.heads)) > 0
        key = self.grammar * self.width + self.name
        at = np.minimum(np.searchsorted(self.heads, key), max(len(self.heads) - 1, 0))
        self.known = (self.name >= 0) & (self.heads[at] == key) if len(key) else np.zeros(0, bool)
        self.callee = at
        self.call = self.known & is_rule[at]
        self.token = (self.name >= 0) & ~self.call
        self.at = np.flatnonzero(np.diff(self.body, prepend=-1))
        self.inner = np.ones(len(self.body), bool)
        self.inner[self.at] = False
        self.then = np.append(self.inner[1:], False)[: len(self.body)]  # another one of the alternative follows
        self.empty = self._empty()
        self.void = (self.name < 0) | (self.known & self.empty[self.callee])
        solid = (~self.void).astype(np.int64)
        before = np.cumsum(solid) - solid
        before -= before[self.at][self.body]
        total = np.bincount(self.body, solid, len(bodies)).astype(np.int64)
        self.leads, self.ends = before == 0, before + solid == total[self.body]

    def _empty(self) -> np.ndarray:
        """Which heads can be nothing: alternatives wait for the calls in them, of none that holds a token."""
        bodies = len(self.body_head)
        able = np.bincount(self.body, self.token, bodies) == 0
        wait = np.flatnonzero(self.call & able[self.body])
        left = np.bincount(self.body[wait], minlength=bodies)
        done, empty = able & (left == 0), np.zeros(len(self.heads), bool)
        new = self.optional.copy()
        while True:
            new[self.body_head[done]] = True
            new &= ~empty
            if not new.any():
                return empty
            empty |= new
            hit = new[self.callee[wait]]
            less = np.bincount(self.body[wait[hit]], minlength=bodies)
            left -= less
            done, wait, new = (less > 0) & (left == 0), wait[~hit], np.zeros(len(self.heads), bool)

    def planes(self, *more: int) -> Iterator[Callable]:
        """For each 64 of every grammar's tokens (and `more` ones): bits of the elements that are tokens, the bit of a word
        in each grammar, and the words of bits."""
        every = np.unique(self.heads // self.width)
        tokens = np.unique(np.concatenate([self.grammar[self.token] * self.width + self.name[self.token], *(every * self.width + w for w in more)]))
        if not len(tokens):
            return
        first = np.searchsorted(tokens, every * self.width)  # of each grammar of the batch
        local = np.arange(len(tokens)) - first[np.searchsorted(every, tokens // self.width)]
        begin = lambda of: first[np.searchsorted(every, of)]

        for plane in range(local.max() // 64 + 1):
            bit = np.where(local // 64 == plane, np.left_shift(np.uint64(1), (local % 64).astype(np.uint64)), np.uint64(0))
            used = min(64, int(local.max()) + 1 - 64 * plane)

            def of(grammar: np.ndarray, word: np.ndarray | int, bit=bit) -> np.ndarray:
                return bit[np.searchsorted(tokens, grammar * self.width + word)]

            def listed(sets: np.ndarray, used=used) -> tuple[np.ndarray, np.ndarray]:
                """(node, bit) of all bits of the sets."""
                octets = np.ascontiguousarray(sets, "<u8").view(np.uint8).reshape(-1, 8)
                return np.nonzero(np.unpackbits(octets, axis=1, count=used, bitorder="little"))

            def word(grammar: np.ndarray, bits: np.ndarray, plane=plane) -> np.ndarray:
                return tokens[begin(grammar) + 64 * plane + bits] % self.width

            yield of, listed, word

    def first(self, of: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The sets of the heads, and of the elements, each alone."""
        own = np.zeros(len(self.body), np.uint64)
        own[self.token] = of(self.grammar[self.token], self.name[self.token])
        sets, lead = np.zeros(len(self.heads), np.uint64), self.leads & self.token
        np.bitwise_or.at(sets, self.head[lead], own[lead])
        lead = self.leads & self.call
        spread(sets, self.head[lead], self.callee[lead])
        own[self.call] = sets[self.callee[self.call]]
        return sets, own

    def after(self, of: Callable, first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What can stand after the heads, and from each element on that has one before it."""
        n = len(self.heads)
        sets = np.zeros(n + len(own), np.uint64)
        sets[:n][self.closure] = first[self.closure]
        sets[:n][self.start] |= of(self.heads[self.start] // self.width, self.eos)
        sets[n:][self.inner] = own[self.inner]
        on, next_, last = np.flatnonzero(self.inner & self.void & self.then), np.flatnonzero(self.call & self.then), self.call & self.ends
        src = np.concatenate([n + on, self.callee[next_], self.callee[last]])
        dst = np.concatenate([n + on + 1, n + next_ + 1, self.head[last]])
        spread(sets, src, dst)
        return sets[:n], sets[n:]

    def begin(self) -> Iterator[tuple]:
        """head, word: what rules can begin with, -1 where one can be nothing."""
        empty = np.flatnonzero(self.empty)
        yield empty, np.full(len(empty), -1)
        for of, listed, word in self.planes():
            head, bits = listed(self.first(of)[0])
            yield head, word(self.heads[head] // self.width, bits)

    def _bodies(self, of: Callable, own: np.ndarray) -> np.ndarray:
        """What the alternatives can begin with."""
        if not len(own):
            return own
        sets = np.bitwise_or.reduceat(np.where(self.leads, own, np.uint64(0)), self.at)
        nothing = np.flatnonzero(np.logical_and.reduceat(self.void, self.at))
        sets[nothing] |= of(self.heads[self.body_head[nothing]] // self.width, self.eps)
        return sets

    def alternative(self) -> Iterator[tuple]:
        for of, listed, word in self.planes(self.eps):
            body, bits = listed(self._bodies(of, self.first(of)[1]))
            head = self.body_head[body]
            yield head, self.body_alt[body], word(self.heads[head] // self.width, bits)

    def follow(self) -> Iterator[tuple]:
        for of, listed, word in self.planes(self.eos):
            head, bits = listed(self.after(of, *self.first(of))[0])
            yield head, word(self.heads[head] // self.width, bits)

    def conflicts(self) -> Iterator[tuple]:
        for of, listed, word in self.planes(self.eos, self.eps):
            first, own = self.first(of)
            follow, rest = self.after(of, first, own)
            body, bits = listed(self._bodies(of, own))
            head, others = listed(np.where(self.empty, follow, np.uint64(0)))
            ways = np.concatenate([self.body_head[body], head]) * 64 + np.concatenate([bits, others])
            here = np.flatnonzero(self.call & self.void)
            stands = np.where(self.ends[here], follow[self.head[here]], np.uint64(0))
            on = self.then[here]
            stands[on] |= rest[here[on] + 1]
            place, bits = listed(stands & first[self.callee[here]])
            for kind, found, least in (("alternatives", ways, 2), ("use", self.callee[here[place]] * 64 + bits, 1)):
                found, n = np.unique(found, return_counts=True)
                head, bits = np.divmod(found[n >= least], 64)
                yield head, kind, word(self.heads[head] // self.width, bits), n[n >= least]

    def reached(self) -> Iterator[tuple]:
        sets = spread(self.start.astype(np.uint64), self.callee[self.call], self.head[self.call])
        yield (np.flatnonzero(sets),)


def boundaries(size: np.ndarray) -> np.ndarray:
    """Where grammars begin, by the number of rows of each row's grammar; the rows begin with a whole one."""
    run = np.flatnonzero(np.diff(size, prepend=-1))
    offset = np.arange(len(size)) - np.repeat(run, np.diff(np.append(run, len(size))))
    return np.flatnonzero(offset % size == 0)


def analysed(what: str, n_ids: int, most: int, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of an analysis. Columns: the ids, rule, alt, pos, names, and size (rows of the grammar) * MARKS + mark; rows
    of a grammar stand together. A grammar of more than `most` rows is named by a row without a rule, and left out."""

    def found(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = lambda i: rows.column(n_ids + i).combine_chunks()
        grammar = np.repeat(np.arange(len(at)), np.diff(np.append(at, rows.num_rows)))
        batch = Batch(grammar, column(0), column(1), column(2), column(3), column(4).to_numpy(zero_copy_only=False) % MARKS)
        ids = [rows.column(i).combine_chunks().take(pa.array(at)) for i in range(n_ids)]
        words, alts = batch.words.cast(pa.string()), batch.alts.cast(pa.string())
        taken = lambda of, codes: of.take(pa.array(codes, mask=codes < 0))
        for head, *values in getattr(batch, what)():
            named, code = pa.array(batch.heads[head] // batch.width), batch.heads[head] % batch.width
            out = {"rule": taken(words, code)}
            for field, v in zip(schema.names[n_ids + 1 :], values, strict=True):
                out[field] = taken(words, v) if field == "token" else taken(alts, v) if field == "alt" else pa.array([v] * len(head), pa.string()) if field == "kind" else pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.take(named) for x in ids), *out.values()], schema=schema)

    held: list[pa.RecordBatch] = []
    for b in batches:
        size = b.column(n_ids + 4).to_numpy(zero_copy_only=False) // MARKS
        if size.max(initial=0) > most:
            names = [f"i{i}" for i in range(n_ids)]
            large = pa.Table.from_arrays(b.filter(pa.array(size > most)).columns[:n_ids], names).group_by(names).aggregate([]).select(names)
            yield from pa.Table.from_arrays([*large.columns, *(pa.nulls(large.num_rows, f.type) for f in list(schema)[n_ids:])], schema=schema).to_batches()
            b = b.filter(pa.array(size <= most))
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            rows = pa.Table.from_batches(held)
            at = boundaries(rows.column(n_ids + 4).to_numpy() // MARKS)
            yield from found(rows.slice(0, at[-1]), at[:-1])
            held = rows.slice(at[-1]).to_batches()
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and rows.num_rows:
        yield from found(rows, boundaries(rows.column(n_ids + 4).to_numpy() // MARKS))
