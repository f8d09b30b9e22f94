"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by up to m // RATE edits. Cut into one piece more than that, at
least one piece must stand in the passage unchanged, so exact hits of the pieces lead to every passage that can match;
around them Myers' bit-parallel distance, on the bits of one integer, decides. Letters A-Z count as small and each
white-space character as a space, in items and texts alike; runs of white space and white space at the ends are dropped.

How hits are found depends on the measured size of the items, their result does not. Up to HELD_CHARS characters of
items go to every task, whose Aho-Corasick automaton of all pieces reads each text once. More items stay tables: pieces
and texts meet on hashes of the pieces' first characters (those of a text that no piece has are left out by a bit table
of at most FILTER_BITS), and texts are read again only for the candidates.

Null or empty items match nothing. Items of fewer than RATE characters have no edits and match where no letter or digit
goes on at either end. Where `short` is not set, items of fewer than MIN_CHARS characters, which prose may hold by chance,
match nothing; it is set unless a caller says otherwise. Null and empty texts match nothing; of equally good passages the first counts. Rows that repeat give rows
that repeat, an empty table on either side none. Other columns are kept or not read, whatever their names. Texts of any
length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, clear_name, mix, numbered, partitions, rows_at_a_time, table, texts_at_a_time

RATE = 16
MIN_CHARS = 24
HELD_CHARS = 4 << 20
#: Pieces meet on their first SEED characters, shorter ones on all.
SEED = 10
FILTER_BITS = 1 << 26

_FOLD = bytes(32 if i in b"\t\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def fold(text: str) -> str:
    """Small Latin letters, and spaces for white space; as many characters as before."""
    return text.encode("utf-8", "replace").translate(_FOLD).decode()


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of all of pattern within text, the first of equals; None beyond `most`."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (most + 1, -1)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = score, j + 1
    return best if best[0] <= most else None


def stands_alone(text: str, s: int, e: int) -> bool:
    """Does no letter or digit at an end of text[s:e] go on beyond it?"""
    return not (s and text[s - 1].isalnum() and text[s].isalnum()) and not (e < len(text) and text[e - 1].isalnum() and text[e].isalnum())


def clean(text: str) -> str:
    """The text as it is matched."""
    return " ".join(fold(text).split())


def edits(item: str) -> int:
    return len(item) // RATE


def cut(item: str) -> list[tuple[int, int]]:
    """Start and end of each piece of an item."""
    k = edits(item) + 1
    return [(p * len(item) // k, (p + 1) * len(item) // k) for p in range(k)]


def best_passage(text: str, item: str, begins: set[int]) -> tuple[int, int] | None:
    """(distance, end) of the best match of an item that may begin about some places of the text."""
    most = edits(item)
    if not most:
        whole = [b + len(item) for b in begins if text.startswith(item, b) and stands_alone(text, b, b + len(item))]
        return (0, min(whole)) if whole else None
    best = None
    windows: list[list[int]] = []
    for b in sorted(begins):
        lo, hi = max(0, b - most), min(len(text), b + len(item) + most)
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = max(hi, windows[-1][1])
        else:
            windows.append([lo, hi])
    for lo, hi in windows:
        exact = text.find(item, lo, hi)
        got = (0, exact + len(item) - lo) if exact >= 0 else myers(item, text[lo:hi], most)
        if got and (best is None or got[0] < best[0]):
            best = got[0], lo + got[1]
    return best


class Matcher:
    """Items by id; an automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], short: bool = True):
        import ahocorasick

        self.items: list[tuple[int, str]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is not None, x)):
            text = clean(text or "")
            if len(text) < MIN_CHARS and not (short and text):
                continue
            for s, e in cut(text):
                at.setdefault(text[s:e], []).append((len(self.items), s))
            self.items.append((item_id, text))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item within its edit budget of some passage, ends in folded text."""
        if not self.items:
            return []
        text = clean(text)
        hits: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, s in where:
                hits.setdefault(n, set()).add(end + 1 - size - s)
        found = [(self.items[n][0], best_passage(text, self.items[n][1], begins)) for n, begins in hits.items()]
        return sorted([(i, *best) for i, best in found if best], key=lambda x: (x[0] is not None, x))


_matchers: dict[str, Matcher] = {}


def matcher(key: str, items: list[tuple[int, str]], short: bool) -> Matcher:
    """The matcher of this worker process."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, short)
    return _matchers[key]


def chosen_items(items: DataFrame, item_col: str, item_text_col: str, short: bool) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item")).where(F.length("item") >= (1 if short else MIN_CHARS))


def seeds(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of `size` code points from each place on."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
    return mix(out + np.uint64(size))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def pieces_of(items: DataFrame, short: bool) -> DataFrame:
    """row, seed, size, at for each piece of each item (row, item): the hash of its first `size` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_at_a_time(batches, 1):
            out = []
            for row, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = clean(item)
                if len(text) >= MIN_CHARS or short and text:
                    for s, e in cut(text):
                        size = min(SEED, e - s)
                        out.append((row, int(seeds(code_points(text[s : s + size]), size).view(np.int64)[0]), size, s))
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["row", "seed", "size", "at"])

    return items.select("row", "item").mapInArrow(run, "row long, seed long, size long, at long")


def candidates(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """row, item_row, begins for each text (row, text) and item with a common piece."""
    sizes = sorted(r.size for r in pieces.select("size").distinct().collect())  # at most SEED of them
    count = pieces.count()
    bits = min(FILTER_BITS, 1 << max(16, (16 * count).bit_length()))
    place = F.pmod("seed", F.lit(bits))
    words = pieces.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(seed, 64) as int))")).alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[np.asarray(words["w"])] = np.asarray(words["bits"]).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(held)  # at most FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in texts_at_a_time(batches, 1):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = code_points(clean(text))
                for size in sizes:
                    h = seeds(points, size)
                    bit = h & np.uint64(bits - 1)
                    at = np.flatnonzero(known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        yield pa.record_batch([pa.array(np.full(len(at), row)), pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), size)), pa.array(at)], names=["row", "seed", "size", "place"])

    hits = docs.select("row", "text").mapInArrow(run, "row long, seed long, size long, place long")
    met = hits.join(pieces.withColumnRenamed("row", "item_row"), ["seed", "size"])
    return met.groupBy("row", "item_row").agg(F.collect_set(F.col("place") - F.col("at")).alias("begins"))


def joined(docs: DataFrame, items: DataFrame, short: bool, scratch: Scratch) -> DataFrame:
    """row, item_id, distance, end of all matches of docs (row, text) and items (item_id, item), both of any size."""
    items = scratch.save(numbered(items, "row", scratch), f"items-{uuid.uuid4().hex}")
    pieces = scratch.save(pieces_of(items, short), f"pieces-{uuid.uuid4().hex}")
    found = candidates(docs, pieces).join(items.withColumnRenamed("row", "item_row"), "item_row")
    # A text goes along with up to sixteen groups of its candidates, so that no group holds all of them.
    told = found.groupBy("row", F.pmod(F.xxhash64("item_row"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("item_id", "item", "begins")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 16):
            out = []
            for r in batch.to_pylist():
                text = clean(r["text"])
                for x in r["found"]:
                    best = best_passage(text, clean(x["item"]), set(x["begins"]))
                    if best:
                        out.append((r["row"], x["item_id"], *best))
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["row", "item_id", "distance", "end"])

    return docs.select("row", "text").join(told, "row").repartition(partitions(docs)).mapInArrow(run, "row long, item_id long, distance long, end long")


def held_items(items: DataFrame, most: int) -> list[tuple[int, str]] | None:
    """The items, if their texts have at most `most` characters in all."""
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    return [(r.item_id, r.item) for r in items.collect()] if total <= most else None


def matches(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short: bool = True, held_chars: int = HELD_CHARS) -> DataFrame:
    """doc_id, item_id, distance, end (in the folded text) for each pair within the item's edit budget."""
    chosen = chosen_items(items, item_col, item_text_col, short)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = held_items(chosen, held_chars)
    if held is None:
        rows = numbered(rows, "row", scratch)
        return joined(rows, chosen, short, scratch).join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "distance", "end")
    shared, key = docs.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(key, shared.value, short)
        for batch in texts_at_a_time(batches, 1):
            found = [(i, *x) for i, text in enumerate(batch.column(1).to_pylist()) for x in own.find(text)]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.record_batch([batch.column(0).take(at), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3))], names=["doc_id", "item_id", "distance", "end"])

    return rows.mapInArrow(run, "doc_id long, item_id long, distance long, end long")


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", short: bool = True, held_chars: int = HELD_CHARS) -> DataFrame:
    """The rows of docs whose text holds a passage of no item, whatever their other columns."""
    chosen = chosen_items(items, item_col, item_text_col, short)
    held = held_items(chosen, held_chars)
    if held is None:
        row = clear_name(docs, "row")
        rows = numbered(docs, row, scratch)
        bad = joined(rows.select(F.col(row).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), chosen, short, scratch).select(F.col("row").alias(row)).distinct()
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    at, shared, key = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(key, shared.value, short)
        for batch in texts_at_a_time(batches, at):
            yield batch.filter(pa.array([not t or not own.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op10"))
