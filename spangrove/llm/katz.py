"""Katz backoff language model of any order (op4 takes trigrams) that scores every text of a corpus.

Tokens are words between ASCII white space with A-Z made small, then one end for each text; before the first token
stand as many start marks as a history has. Training texts are those whose crc32 of the id as text is not HELD_OUT
modulo FOLDS.

    unigram   P(w) = d(c) c / N for a word seen c times; all words never seen share what is left, as one event
    n-gram    P(w | h) = d(c) c / c(h)  where h w was seen c times, else  a(h) P(w | h'), h' being h without its first
              a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of P(w | h') over the words seen after h);  1 if h wasn't seen

d is the Good-Turing discount of Katz, of each level, for counts up to K and 1 above; where the counts of counts give none
between 0 and 1, (c - 1/2) / c. If a history has no discounted mass (or the unigrams have none), all its counts are divided
by one more than their sum instead, which leaves 1 / (sum + 1). So the probabilities after every history sum to one.

How it runs. Texts are read once and written as blocks of token ids local to the block. Each block sends its distinct
words, with training counts, to buckets by hash; a bucket merges them by their bytes and answers each block with word ids
(small for frequent words) and counts. Everything that the recursion after a word b needs, at every level, are the
n-grams whose history ends in b; so each block sends its distinct n-grams of the full order once, to the bucket of b,
which merges them, counts all levels, and keeps where each block's n-grams stand among the merged ones. When the counts
of counts of all buckets are summed, each bucket evaluates its n-grams recursively from the unigrams up and answers
with logarithms, of which a training text needs few different ones.

A word b with more than HOT training tokens would make too large a bucket. After such a word, levels go one by one: blocks
send n-grams of each level to buckets by history, and a history of more than HOT training tokens is cut by the words after
it into parts of about that many; buckets answer with counts and with the sums of each part, which the block adds up and
recurses on.

What travels are the distinct keys of a block, not occurrences, so a frequent word is one entry for each block. The number
of buckets follows the counted tokens. Driver and broadcasts hold only counts of counts. The counts of words and of n-grams
stay in the scratch folder as tables, a row of squeezed arrays for each bucket (model reads them as typed rows).

Null and empty texts have one token, the end. Rows that share an id are scored one by one. A null id counts as ''. An
empty table gives no rows. Other columns are not read, whatever their names. Texts of any length are taken whole: one text
is in one block.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, arrow_bytes, distinct_spans, give_back, mix, partitions, rows_at_a_time, table, texts_at_a_time, word_spans

FOLDS, HELD_OUT = 7, 2
K = 5
BLOCK_TOKENS = 1_200_000
SLICE_BYTES = 4 << 20
HOT = 1 << 19
#: Training tokens whose n-grams a bucket gets, on average.
BUCKET_TOKENS = 200_000
END = b""


@functools.cache
def packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@functools.cache
def unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed byte planes; whole numbers that aren't negative in as few bytes as hold them."""
    a = np.ascontiguousarray(a)
    if a.dtype.kind == "u" and len(a):
        most = int(a.max())
        a = a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
    each = a.view(np.uint8).reshape(len(a), a.itemsize)
    planes = np.empty((a.itemsize, len(a)), np.uint8)
    for i in range(a.itemsize):  # a plane at a time: numpy's own transposition takes a few bytes at a time
        planes[i] = each[:, i]
    return a.dtype.char.encode() + packer().compress(planes)


def expand(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    planes = np.frombuffer(unpacker().decompress(b[1:]), np.uint8).reshape(kind.itemsize, -1)
    each = np.empty((planes.shape[1], kind.itemsize), np.uint8)
    for i in range(kind.itemsize):
        each[:, i] = planes[i]
    return each.reshape(-1).view(kind)


def expand_ids(b: bytes) -> np.ndarray:
    return expand(b).astype(np.uint64)


def squeeze_words(words: pa.Array) -> bytes:
    """Words hold no line breaks."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return packer().compress(np.insert(raw, ends[1:] - ends[0], 10).tobytes())


def expand_words(b: bytes) -> pa.Array:
    raw = np.frombuffer(unpacker().decompress(b), np.uint8)
    at = np.flatnonzero(raw == 10)
    ends = np.append(0, at - np.arange(len(at))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[raw != 10]))])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (whole numbers, none negative) in order, where each stands first, and which of them each key is.
    Where a key and its place fit in 64 bits, they are sorted as one number, far quicker than an order is found."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = (n - 1).bit_length()
    if int(keys.max()).bit_length() + bits <= 64:
        both = keys.astype(np.uint64)
        both <<= bits
        both |= np.arange(n, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << bits) - 1)).view(np.int64)
        both >>= bits
        keys = both.astype(keys.dtype, copy=False)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    some, first, nth = keys[new], order[new], np.cumsum(new)
    nth -= 1
    back = np.empty(n, np.int64)
    back[order] = nth
    return some, first, back


def rising(a: np.ndarray) -> bytes:
    """Ids that never fall, squeezed as the steps between them."""
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_rising(b: bytes) -> np.ndarray:
    return np.cumsum(expand_ids(b), dtype=np.uint64)


def sorted_by(bucket: np.ndarray) -> np.ndarray:
    """The stable order by bucket."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and int(bucket.max()) < 1 << 16 else bucket, kind="stable")


class Discounts:
    """d(c) from the counts of counts 1 to K + 1."""

    def __init__(self, n: list[int]):
        self.d = np.ones(K + 1)
        top = (K + 1) * n[K] / n[0] if n[0] else 1.0
        for r in range(1, K + 1):
            good = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
            d = (good - top) / (1 - top) if top != 1 else 0.0
            self.d[r] = d if 0 < d < 1 else (r - 0.5) / r

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, self.d[np.minimum(c, K)], 1.0)

    @property
    def lost(self) -> np.ndarray:
        """What one n-gram of count 1 to K gives away."""
        return (1 - self.d[1:]) * np.arange(1, K + 1)


class Unigrams:
    def __init__(self, total: int, n: list[int]):
        self.total = total
        self.discounts = Discounts(n)
        lost = sum((1 - self.discounts.d[r]) * r * n[r - 1] for r in range(1, K + 1))
        self.flat = total > 0 and lost <= 0
        self.unseen = 1.0 if not total else 1 / (total + 1) if self.flat else lost / total

    @property
    def whole(self) -> int:
        """What d(c) c is divided by."""
        return self.total + self.flat

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = c / (self.total + 1) if self.flat else self.discounts.of(c) * c / max(self.total, 1)
        return np.where(c > 0, seen, self.unseen)


def backoff(total: np.ndarray, lower: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a(h), and whether h has no discounted mass; lost: the counts' discounted mass."""
    flat = (total > 0) & (lost <= 0)
    left = np.where(flat, 1 / (total + 1), lost / np.maximum(total, 1))
    return np.where(total > 0, left / np.maximum(1 - lower, 1e-300), 1.0), flat


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def longs(a: np.ndarray) -> pa.ListArray:
    """One row that holds all of a."""
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a.astype(np.int64)))


def columns(a: list[np.ndarray]) -> pa.ListArray:
    """One row that holds a list for each of a."""
    ends = np.append(0, np.cumsum([len(x) for x in a]))
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(a).astype(np.int64)))
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), inner)


def blob(a: np.ndarray) -> pa.Array:
    return pa.array([squeeze(a)], pa.binary())


def row_of(schema: pa.Schema, **values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(1, f.type)).cast(f.type) for f in schema], schema=schema)


def rows_of(schema: pa.Schema, rows: Iterator[dict], most: int = 64, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches: a batch for each would cost more than what is in it."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r.values() if isinstance(x, bytes))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


BLOCKS = "kind string, block long, bucket int, a binary, b binary, docs array<long>, lens array<long>"


def blocks_of(docs: DataFrame, buckets: int, block_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Rows kind 't' (a block's tokens) and kind 'w' (its distinct words of one bucket, with training counts).

    Local ids of words go by bucket and then word.
    """

    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {END: 0}
        ids: list = []
        lens: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n, flat = np.concatenate(lens), np.concatenate(tokens)
            train = np.repeat(~np.array([is_held_out(i) for i in ids]), n)
            counts = np.bincount(flat[train], minlength=len(known)).astype(np.uint32)
            words = pa.array(list(known), pa.binary())
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in known), np.int64, len(known))
            order = np.asarray(pc.sort_indices(words)).astype(np.int64)
            order = order[sorted_by(bucket[order])]
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = words.take(pa.array(order))
            block = pa.array([number])
            yield row_of(schema, kind=pa.array(["t"]), block=block, a=blob(rank[flat]), docs=pa.array([ids], pa.list_(pa.int64())), lens=longs(n))
            ends, counts = np.searchsorted(bucket[order], np.arange(buckets + 1)), counts[order]
            parts = ((k, slice(ends[k], ends[k + 1])) for k in np.flatnonzero(np.diff(ends)).tolist())
            yield from rows_of(schema, ({"kind": "w", "block": number, "bucket": k, "a": squeeze_words(words[mine]), "b": squeeze(counts[mine])} for k, mine in parts))

        for batch in give_back(texts_at_a_time(batches, 1, SLICE_BYTES)):
            buf, offsets = arrow_bytes(batch.column(1))
            buf = LOWER[buf]
            s, e = word_spans(buf, offsets)
            words, of = distinct_spans(buf, s, e)
            local = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
            first = np.searchsorted(s, offsets)
            ids += batch.column(0).to_pylist()
            lens.append(np.diff(first) + 1)
            tokens.append(np.insert(local[of] if len(of) else np.zeros(0, np.int64), first[1:], 0))
            held += len(tokens[-1])
            if held >= block_tokens:
                yield from flush()
                number, held = number + 1, 0
                known, ids, lens, tokens = {END: 0}, [], [], []
        if ids:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket of a partition that is sorted by bucket."""
    now, rows = None, []
    for batch in give_back(rows_at_a_time(batches, 64)):
        for r in batch.to_pylist():
            if r["bucket"] != now:
                if rows:
                    yield now, rows
                now, rows = r["bucket"], []
            rows.append(r)
    if rows:
        yield now, rows


UNIGRAMS = "level string, block long, bucket int, a binary, b binary, first long, words array<string>, counts array<long>, sums array<long>"
TABLE_ROWS = 100_000


def count_words(buckets: int):
    """For each bucket of words: answers to the blocks, the merged counts (the id of a word is (first + its place) *
    buckets + bucket), and sums: tokens, words seen, ends, counts of counts; then the largest count and the words asked for."""
    schema = arrow_schema(UNIGRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            asked = [expand_words(r["a"]) for r in rows]
            coded = pa.concat_arrays(asked).dictionary_encode()
            known, of = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
            counts = np.bincount(of, np.concatenate([expand(r["b"]) for r in rows]), len(known)).astype(np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            gid = rank * np.uint64(buckets) + np.uint64(bucket)
            ends = np.append(0, np.cumsum([len(x) for x in asked]))
            parts = ((r["block"], of[a:b]) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True))
            yield from rows_of(schema, ({"level": "answer", "block": block, "bucket": bucket, "a": squeeze(gid[at]), "b": squeeze(counts[at].astype(np.uint64))} for block, at in parts))
            end = pc.index(known, pa.scalar(END, pa.binary())).as_py()
            sums = [int(counts.sum()), int((counts > 0).sum()), int(counts[end]) if end >= 0 else 0, *counts_of_counts(counts), int(counts.max()), len(known)]
            words = known.cast(pa.string())
            for i in range(0, len(order), TABLE_ROWS):
                some = order[i : i + TABLE_ROWS]
                held = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), words.take(pa.array(some)))
                yield row_of(schema, level=pa.array(["unigrams"]), bucket=pa.array([bucket]), first=pa.array([i]), words=held, counts=longs(counts[some]), sums=pa.array([[0] * len(sums) if i else sums]))

    return run


KNOWN = "block long, tokens binary, gid binary, count binary, docs array<long>, lens array<long>"


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KNOWN: blocks whose words are ranks in the order of their ids, from tokens and what the buckets answered."""
    for batch in give_back(rows_at_a_time(batches, 1)):
        answers = sorted(batch.column("words").to_pylist()[0], key=lambda r: r["bucket"])
        gid, count = (np.concatenate([expand_ids(r[k]) for r in answers]) for k in "ab")
        by = np.argsort(gid)
        rank = np.empty(len(gid), np.uint32)
        rank[by] = np.arange(len(gid), dtype=np.uint32)
        tokens = rank[expand(batch.column("a")[0].as_py())]
        values = [batch.column("block"), blob(tokens), blob(np.diff(gid[by], prepend=np.uint64(0))), blob(count[by]), batch.column("docs"), batch.column("lens")]
        yield pa.RecordBatch.from_arrays(values, names=["block", "tokens", "gid", "count", "docs", "lens"])


class Words:
    """A block's tokens with the ids and counts of its words; the rank after the last word is the start mark. starts:
    the texts that were trained on, and an id beyond all words for the mark."""

    def __init__(self, row: dict, starts: tuple[int, int], order: int):
        gid, count = np.cumsum(expand_ids(row["gid"])), expand(row["count"]).astype(np.int64)
        self.gid, self.count = np.append(gid, np.uint64(starts[1])), np.append(count, starts[0])
        self.tokens = expand(row["tokens"]).astype(np.int64)
        self.docs, self.lens = row["docs"], np.array(row["lens"], np.int64)
        self.begins = np.cumsum(self.lens) - self.lens
        self.train = np.repeat(~np.array([is_held_out(i) for i in self.docs], bool), self.lens)
        # The words before each token, the nearest first.
        self.before: list[np.ndarray] = []
        x = self.tokens
        for _ in range(order - 1):
            y = np.empty_like(x)
            y[1:] = x[:-1]
            y[self.begins] = len(gid)
            self.before.append(y)
            x = y


class Grams:
    """The distinct n-grams at some places of a block, in the order of the words before, nearest first, then the word."""

    def __init__(self, words: Words, level: int, places: np.ndarray):
        width = len(words.gid)
        if level == 2:
            keys, _, hid = distinct(words.before[0][places])
            self.h = [keys]
        else:  # two ranks of a block fit in one number
            keys, _, hid = distinct(words.before[0][places] * width + words.before[1][places])
            self.h = [keys // width, keys % width]
        for x in words.before[2 : level - 1]:
            keys, _, hid = distinct(hid * width + x[places])
            self.h = [c[keys // width] for c in self.h] + [keys % width]
        keys, first, self.back = distinct(hid * width + words.tokens[places])
        #: For each n-gram its history and its word.
        self.hist, self.word = keys // width, keys % width
        self.seen = np.bincount(self.back[words.train[places]], minlength=len(keys)).astype(np.uint32)
        #: A place of each n-gram.
        self.place = places[first]


class Cold:
    """The n-grams of the full order after words that are not hot, as they are sent to the buckets of these words."""

    def __init__(self, words: Words, order: int, buckets: int, hot: int):
        self.places = np.flatnonzero(words.count[words.before[0]] <= hot)
        self.grams = g = Grams(words, order, self.places)
        bucket = bucket_of(words.gid[g.h[0]], buckets)
        self.histories = sorted_by(bucket)
        of = bucket[g.hist]
        self.order = sorted_by(of)
        self.ends = np.searchsorted(bucket[self.histories], np.arange(buckets + 1))
        self.gram_ends = np.searchsorted(of[self.order], np.arange(buckets + 1))


#: h: the words before, nearest first; runs: how many n-grams each history has; last: their distinct words; w: which of these each has.
REQUEST = "block long, bucket int, h array<binary>, runs binary, w binary, seen binary, last binary, last_count binary"


def ask_cold(order: int, buckets: int, hot: int, starts: tuple[int, int]):
    schema = arrow_schema(REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(rows_at_a_time(batches, 1)):
            row = batch.to_pylist()[0]
            words = Words(row, starts, order)
            x = Cold(words, order, buckets, hot)
            g = x.grams
            runs = np.bincount(g.hist, minlength=len(g.h[0])).astype(np.uint32)
            yield from rows_of(schema, (request(row["block"], words, x, runs, k) for k in np.flatnonzero(np.diff(x.ends)).tolist()))

    def request(block: int, words: Words, x: Cold, runs: np.ndarray, k: int) -> dict:
        g, hs, gs = x.grams, x.histories[x.ends[k] : x.ends[k + 1]], x.order[x.gram_ends[k] : x.gram_ends[k + 1]]
        last, _, w = distinct(g.word[gs])
        return {
            "block": block, "bucket": k, "h": [squeeze(words.gid[c[hs]]) for c in g.h], "runs": squeeze(runs[hs]), "w": squeeze(w.astype(np.uint32)),
            "seen": squeeze(g.seen[gs]), "last": rising(words.gid[last]), "last_count": squeeze(words.count[last].astype(np.uint64)),
        }

    return run


#: h: the words before, nearest first, the nearest as steps; w: which of the distinct words in `last` (as steps) is the last.
COLD = "bucket int, h array<binary>, w binary, c binary, last binary, last_count binary, asked array<struct<block:long,at:binary>>, sums array<long>"


class Merged:
    """The merged n-grams of a bucket, sorted by the words before, nearest first, then the word."""

    def __init__(self, h: list[np.ndarray], word: np.ndarray, last: np.ndarray):
        """h: the words before, nearest first; word: their places in `last`."""
        self.h, self.word, self.last = h, word, last
        changed = np.ones(len(word), bool)
        changed[1:] = False
        self.hid = []  # for each level from 2 the history of each n-gram
        for column in h:
            changed[1:] |= column[1:] != column[:-1]
            self.hid.append(np.cumsum(changed) - 1)

    def pairs(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(history of each n-gram of a level, a member of each, the level's n-gram of each member)."""
        hid = self.hid[level - 2]
        if level == len(self.h) + 1:
            every = np.arange(len(hid))
            return hid, every, every
        width = max(len(self.last), 1)
        keys, first, back = distinct(hid * width + self.word)
        return keys // width, first, back


def count_cold(order: int):
    """For each bucket the merged counts of the full order, who asked for which, and the counts of counts of each level."""

    schema = arrow_schema(COLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            lasts = [expand_rising(r["last"]) for r in rows]
            last, _, of_last = distinct(np.concatenate(lasts))
            last_count = np.zeros(len(last), np.int64)
            last_count[of_last] = np.concatenate([expand_ids(r["last_count"]) for r in rows]).astype(np.int64)
            w = [expand(r["w"]).astype(np.int64) for r in rows]
            sizes = np.array([len(x) for x in w])
            ends = np.cumsum(sizes)
            word = of_last[np.concatenate(w) + np.repeat(np.cumsum([0, *map(len, lasts[:-1])]), sizes)]
            runs = np.concatenate([expand(r["runs"]).astype(np.int64) for r in rows])
            h: list[np.ndarray] = []
            for j in range(order - 1):
                column, _, at = distinct(np.concatenate([expand_ids(r["h"][j]) for r in rows]))
                if not h:
                    h, hi = [column], at
                    continue
                keys, _, hi = distinct(hi * len(column) + at)
                h = [c[keys // len(column)] for c in h] + [column[keys % len(column)]]
            keys, _, back = distinct(np.repeat(hi, runs) * len(last) + word)
            counts = np.bincount(back, np.concatenate([expand(r["seen"]) for r in rows]), len(keys)).astype(np.int64)
            of, word = keys // len(last), keys % len(last)
            merged = Merged([c[of] for c in h], word, last)
            del hi, keys, w, h, lasts
            sums = []
            for level in range(2, order + 1):
                _, first, pair = merged.pairs(level)
                sums += counts_of_counts(np.bincount(pair, counts, len(first)).astype(np.int64))
            begins = ends - sizes
            steps = np.diff(back, prepend=0)
            steps[begins] = back[begins]
            steps = steps.astype(np.uint32)
            asked = [{"block": r["block"], "at": squeeze(steps[a:b])} for r, a, b in zip(rows, begins, ends, strict=True)]
            h = [rising(merged.h[0]), *(squeeze(c) for c in merged.h[1:])]
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "h": h, "w": squeeze(word.astype(np.uint32)), "c": squeeze(counts.astype(np.uint64)), "last": rising(last), "last_count": squeeze(last_count.astype(np.uint64)), "asked": asked, "sums": sums}], schema=schema)

    return run


def grams_of(row: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of COLD the words before, nearest first, the places of the last words, these words, and the counts."""
    h = [expand_rising(row["h"][0]), *(expand_ids(x) for x in row["h"][1:])]
    return h, expand(row["w"]).astype(np.int64), expand_rising(row["last"]), expand_ids(row["c"]).astype(np.int64)


def evaluate(m: Merged, counts: np.ndarray, last_count: np.ndarray, unigrams: Unigrams, discounts: list[Discounts]) -> np.ndarray:
    """P of each n-gram, by recursion from the unigrams up."""
    p = unigrams.p(last_count)[m.word]
    for level, d in enumerate(discounts, 2):
        of, first, pair = m.pairs(level)
        c = np.bincount(pair, counts, len(first)).astype(np.int64)
        n = int(m.hid[level - 2][-1]) + 1 if len(m.word) else 0
        seen = c > 0
        total = np.bincount(of, c, n)
        lost = np.bincount(of, np.where(seen, (1 - d.of(c)) * c, 0.0), n)
        below = p[first]
        a, flat = backoff(total, np.bincount(of, np.where(seen, below, 0.0), n), lost)
        p = np.where(seen, d.of(c) * c / (np.maximum(total, 1) + flat)[of], a[of] * below)[pair]
    return p


ANSWER = "block long, bucket int, values binary, at binary"


def answer_cold(unigrams: Unigrams, discounts: list[Discounts]):
    """For each block that asked a bucket, log10 P of its n-grams: the distinct values, and which each has."""

    schema = arrow_schema(ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(rows_at_a_time(batches, 1)):
            row = batch.to_pylist()[0]
            h, w, last, c = grams_of(row)
            last_count = expand_ids(row["last_count"]).astype(np.int64)
            with np.errstate(divide="ignore"):
                log_p = np.log10(evaluate(Merged(h, w, last), c, last_count, unigrams, discounts))
            yield from rows_of(schema, (answer(row["bucket"], x, log_p) for x in row["asked"]))

    def answer(bucket: int, x: dict, log_p: np.ndarray) -> dict:
        values, at = np.unique(log_p[np.cumsum(expand(x["at"]).astype(np.int64))], return_inverse=True)
        return {"block": x["block"], "bucket": bucket, "values": squeeze(values), "at": squeeze(at.astype(np.uint32))}

    return run


# After hot words, level by level.


class Hot:
    """The n-grams of one level after hot words, ordered by bucket, history, part of the history, and word.

    lower: the same of the level below, with its answers; None below bigrams.
    """

    def __init__(self, words: Words, level: int, lower: Hot | None, buckets: int, hot: int):
        self.places = np.flatnonzero(words.count[words.before[0]] > hot)
        self.grams = g = Grams(words, level, self.places)
        self.at = np.full(len(words.tokens), -1)
        self.at[self.places] = g.back
        n = len(g.h[0])
        place = np.empty(n, np.int64)  # a place of each history
        place[g.hist] = g.place
        if lower is None:
            size, self.c = words.count[g.h[0]], words.count[g.word]
        else:
            # The history is an n-gram of the level below at the place before; unless that stands after a hot word too, it is not hot.
            begin = np.zeros(len(words.tokens), bool)
            begin[words.begins] = True
            of = np.where(begin[place], -1, lower.at[place - 1])
            size = np.where(begin[place], words.count[-1], np.where(of >= 0, lower.counts[of] if len(lower.counts) else 0, 0))
            self.below = lower.at[g.place]
            self.c = lower.counts[self.below]
        self.c = np.where(g.seen > 0, self.c, 0).astype(np.uint64)
        self.gids = np.stack([words.gid[c] for c in g.h])
        parts = np.maximum(1, -(-size.astype(np.int64) // hot))
        self.ph = np.repeat(np.arange(n), parts)
        start = np.cumsum(parts) - parts
        self.pp = (np.arange(len(self.ph)) - np.repeat(start, parts)).astype(np.uint32)
        key = self.gids[0].copy()
        for c in self.gids[1:]:
            key = mix(key) + c
        pb = bucket_of(key[self.ph] + self.pp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), buckets)
        order = sorted_by(pb)
        self.ph, self.pp, self.pb = self.ph[order], self.pp[order], pb[order]
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        of = where[start[g.hist] + (mix(words.gid[g.word]) % parts[g.hist].astype(np.uint64)).astype(np.int64)]
        self.order = np.argsort(of, kind="stable")
        self.of = of[self.order]

    def answered(self, answers: list[dict]) -> list[dict]:
        answers = sorted(answers, key=lambda r: r["bucket"])
        self.counts = np.empty(len(self.order), np.int64)
        if len(self.order):
            self.counts[self.order] = np.concatenate([expand_ids(r["a"]) for r in answers])
        return answers

    def p(self, answers: list[dict], d: Discounts, lower: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P of each n-gram, and what d(c) c of it is divided by, from the same of the grams below."""
        g, n = self.grams, self.gids.shape[1]
        if not n:
            return np.zeros(0), np.zeros(0)
        add = lambda x: np.bincount(self.ph, x, n)  # noqa: E731  parts of a history
        total = add(np.concatenate([expand(r["b"]).astype(float) for r in answers]))
        lost = add(np.concatenate([(expand(r["d"]).reshape(-1, K) * d.lost).sum(axis=1) for r in answers]))
        divisor = np.ones(n)
        divisor[g.hist] = whole
        a, flat = backoff(total, add(np.concatenate([expand(r["c"]) for r in answers])) / np.maximum(divisor, 1), lost)
        divisor = (np.maximum(total, 1) + flat)[g.hist]
        return np.where(self.counts > 0, d.of(self.counts) * self.counts / divisor, a[g.hist] * lower), divisor


ASK_HOT = "block long, bucket int, h array<binary>, part binary, runs binary, w binary, seen binary, c binary"


def ask_hot(level: int, order: int, buckets: int, hot: int, starts: tuple[int, int]):
    schema = arrow_schema(ASK_HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(rows_at_a_time(batches, 1)):
            row = batch.to_pylist()[0]
            words = Words(row, starts, order)
            x = None
            for n in range(2, level + 1):
                x = Hot(words, n, x, buckets, hot)
                if n < level:
                    x.answered(row[f"level{n}"] or [])
            g = x.grams
            runs = np.bincount(x.of, minlength=len(x.ph)).astype(np.uint32)
            ends = np.searchsorted(x.pb, np.arange(buckets + 1))
            begin = np.append(0, np.cumsum(runs.astype(np.int64)))[ends]
            parts = ((k, slice(ends[k], ends[k + 1]), x.order[begin[k] : begin[k + 1]]) for k in np.flatnonzero(np.diff(ends)).tolist())
            yield from rows_of(
                schema,
                (
                    {
                        "block": row["block"], "bucket": k, "h": [squeeze(c[x.ph[p]]) for c in x.gids], "part": squeeze(x.pp[p]),
                        "runs": squeeze(runs[p]), "w": squeeze(words.gid[g.word[b]]), "seen": squeeze(g.seen[b]), "c": squeeze(x.c[b]),
                    }
                    for k, p, b in parts
                ),
            )

    return run


HOT_COUNTS = "kind string, block long, bucket int, a binary, b binary, c binary, d binary, w array<array<long>>, counts array<long>, sums array<long>"


def count_hot(level: int, below: Discounts):
    """For each bucket of n-grams: answers to the blocks (counts; for each history and part the total, the sum of d(c) c
    of the level below, and the counts of small counts), the merged counts, and sums."""

    schema = arrow_schema(HOT_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            part, runs, w, seen, c = (np.concatenate([expand_ids(r[k]) for r in rows]) for k in ("part", "runs", "w", "seen", "c"))
            runs = runs.astype(np.int64)
            hi = np.zeros(len(part), np.int64)
            h: list[np.ndarray] = []
            for column in [np.concatenate([expand_ids(r["h"][j]) for r in rows]) for j in range(level - 1)] + [part]:
                column, _, at = distinct(column)
                keys, _, hi = distinct(hi * len(column) + at)
                h = [x[keys // len(column)] for x in h] + [column[keys % len(column)]]
            n = len(h[0])
            words, _, wi = distinct(w)
            keys, _, back = distinct(np.repeat(hi, runs) * max(len(words), 1) + wi)
            counts = np.bincount(back, seen, len(keys)).astype(np.int64)
            of, word = keys // max(len(words), 1), keys % max(len(words), 1)
            low = np.zeros(len(keys))
            some = c > 0
            low[back[some]] = below.of(c[some].astype(np.int64)) * c[some]
            hit = counts > 0
            total = np.bincount(of[hit], counts[hit], n).astype(np.int64)
            lower = np.bincount(of[hit], low[hit], n)
            few = hit & (counts <= K)
            small = np.bincount(of[few] * K + counts[few] - 1, minlength=n * K).reshape(n, K).astype(np.uint32)
            sizes = [(len(expand(r["part"])), len(expand(r["w"]))) for r in rows]
            at = np.cumsum([(0, 0), *sizes], axis=0)
            parts = ((r["block"], hi[p:q], back[a:b]) for r, (p, a), (q, b) in zip(rows, at[:-1], at[1:], strict=True))
            yield from rows_of(
                schema,
                (
                    {"kind": "answer", "block": block, "bucket": bucket, "a": squeeze(counts[b].astype(np.uint64)), "b": squeeze(total[p].astype(np.uint64)), "c": squeeze(lower[p]), "d": squeeze(small[p].ravel())}
                    for block, p, b in parts
                ),
            )
            w = [x[of[hit]] for x in h[: level - 1]][::-1] + [words[word[hit]]]
            yield row_of(schema, kind=pa.array(["grams"]), bucket=pa.array([bucket]), w=columns(w), counts=longs(counts[hit]), sums=pa.array([counts_of_counts(counts)]))

    return run


def score_blocks(order: int, buckets: int, hot: int, starts: tuple[int, int], unigrams: Unigrams, discounts: list[Discounts], vocabulary: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(rows_at_a_time(batches, 1)):
            row = batch.to_pylist()[0]
            x = Words(row, starts, order)
            c = x.count[x.tokens]
            log_p = np.empty(len(c))
            with np.errstate(divide="ignore"):
                if order == 1:
                    log_p = np.log10(unigrams.p(c))
                else:
                    cold = Cold(x, order, buckets, hot)
                    answers = sorted(row["cold"] or [], key=lambda r: r["bucket"])
                    if len(cold.order):
                        own = np.empty(len(cold.order))
                        own[cold.order] = np.concatenate([expand(r["values"])[expand(r["at"])] for r in answers])
                        log_p[cold.places] = own[cold.grams.back]
                if "level2" in row:
                    g, lower = None, None
                    for n, d in enumerate(discounts, 2):
                        up = Hot(x, n, g, buckets, hot)
                        answers = up.answered(row[f"level{n}"] or [])
                        if g is None:
                            p, whole = unigrams.p(x.count[up.grams.word]), np.full(len(up.grams.word), float(unigrams.whole))
                        else:
                            p, whole = lower[0][up.below], lower[1][up.below]
                        lower, g = up.p(answers, d, p, whole), up
                    log_p[g.places] = np.log10(lower[0])[g.grams.back]
            score = np.add.reduceat(log_p, x.begins)
            known = np.add.reduceat((c > 0).astype(np.int64), x.begins)
            base = np.add.reduceat(np.log10((c + 1) / (unigrams.total + vocabulary + 1)), x.begins)
            held = [is_held_out(i) for i in x.docs]
            yield pa.record_batch([pa.array(x.docs, pa.int64()), pa.array(held), pa.array(x.lens), pa.array(known), pa.array(np.full(len(held), unigrams.total, np.int64)), pa.array(base), pa.array(score)], names=names)

    return run


def sums_of(rows: DataFrame, n: int) -> list[int]:
    """The sums of the first n places of `sums`."""
    got = rows.agg(*(F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(n))).first()
    return [int(x) for x in got]


def score(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block_tokens: int = BLOCK_TOKENS, order: int = 2, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    shuffle = partitions(docs)
    deal = lambda df, n: df.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    blocks = scratch.save(blocks_of(docs, shuffle, block_tokens, id_col, text_col), "blocks", "kind")
    words = deal(blocks.where("kind = 'w'").select("block", "bucket", "a", "b"), shuffle)
    first = scratch.save(words.mapInArrow(count_words(shuffle), UNIGRAMS), "unigrams", "level")
    table_rows = first.where("level = 'unigrams'")
    got = sums_of(table_rows, 4 + K)
    total, vocabulary, counts = got[0], got[1], got[3:]
    most = table_rows.agg(F.max(F.get("sums", F.lit(4 + K))).alias("top"), F.max(F.get("sums", F.lit(5 + K))).alias("words")).first()
    starts = got[2], (most.words or 0) * shuffle
    unigrams = Unigrams(total, counts)
    answers = first.where("level = 'answer'").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b")).alias("words"))
    known = blocks.where("kind = 't'").select("block", "a", "docs", "lens").join(answers, "block")
    known = scratch.save(known.mapInArrow(settle, KNOWN), "known")
    scratch.drop("blocks", "unigrams/level=answer")
    buckets = max(shuffle, -(-total // bucket_tokens))
    # A reader holds the rows of a file at once, and a task writes one file: few buckets for each task.
    tasks = max(shuffle, buckets // 2)
    discounts: list[Discounts] = []
    whole = known
    if order > 1:
        asked = known.mapInArrow(ask_cold(order, buckets, hot, starts), REQUEST)
        cold = scratch.save(deal(asked, tasks).mapInArrow(count_cold(order), COLD), "cold")
        of_level = np.array(sums_of(cold, (K + 1) * (order - 1))).reshape(order - 1, K + 1)
        below = unigrams.discounts
        for level in range(2, order + 1):
            if max(most.top or 0, starts[0]) > hot:
                asked = known.mapInArrow(ask_hot(level, order, buckets, hot, starts), ASK_HOT)
                saved = scratch.save(deal(asked, tasks).mapInArrow(count_hot(level, below), HOT_COUNTS), f"hot{level}", "kind")
                of_level[level - 2] += sums_of(saved.where("kind = 'grams'"), K + 1)
                answers = saved.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b", "c", "d")).alias(f"level{level}"))
                known = known.join(answers, "block", "left")
            below = Discounts(of_level[level - 2].tolist())
            discounts.append(below)
        told = cold.mapInArrow(answer_cold(unigrams, discounts), ANSWER)
        told = scratch.save(told.repartition(shuffle, "block"), "told")
        whole = known.join(told.groupBy("block").agg(F.collect_list(F.struct("bucket", "values", "at")).alias("cold")), "block", "left")
    return whole.mapInArrow(score_blocks(order, buckets, hot, starts, unigrams, discounts, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def told_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words, count: a row for each n-gram of COLD."""
    for batch in rows_at_a_time(batches, 1):
        h, w, last, c = grams_of(batch.to_pylist()[0])
        words = np.stack([*h[::-1], last[w]], axis=1).astype(np.int64)
        for i in range(0, len(c), TABLE_ROWS):
            some = words[i : i + TABLE_ROWS]
            ends = np.arange(len(some) + 1, dtype=np.int32) * words.shape[1]
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends), pa.array(some.ravel())), pa.array(c[i : i + TABLE_ROWS])], names=["words", "count"])


def model(spark: SparkSession, scratch: Scratch, level: int) -> DataFrame:
    """The counts that `score` left: bucket, rank, word, count for level 1; words (the ids of a start mark and of
    words, rank * buckets + bucket) and count for the order. The counts of levels between are sums of the latter."""
    if level == 1:
        rows = spark.read.schema(UNIGRAMS).parquet(f"{scratch.root}/unigrams").where("level = 'unigrams'")
        each = rows.select("bucket", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
        return each.select(F.col("bucket").cast("long").alias("bucket"), (F.col("first") + F.col("at")).alias("rank"), F.col("x.words").alias("word"), F.col("x.counts").alias("count")).where("count > 0")
    cold = spark.read.schema(COLD).parquet(f"{scratch.root}/cold").select("h", "w", "c", "last")
    rows = cold.mapInArrow(told_grams, "words array<long>, count long")
    jvm = spark.sparkContext._jvm
    hot = jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/hot{level}")
    if hot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hot):
        grams = spark.read.schema(HOT_COUNTS).parquet(hot.toString()).where("kind = 'grams'").select("w", "counts")
        each = grams.select(F.explode(F.arrays_zip(*(F.get("w", F.lit(j)).alias(f"w{j}") for j in range(level)), F.col("counts").alias("c"))).alias("x"))
        rows = rows.unionByName(each.select(F.array(*(F.col(f"x.w{j}") for j in range(level))).alias("words"), F.col("x.c").alias("count")))
    return rows.where("count > 0")


def op4_katz(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), order=order)
