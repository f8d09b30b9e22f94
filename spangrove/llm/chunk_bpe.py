"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts texts where its low bits are zero, so that a passage is cut alike in
every document that holds it. Each distinct chunk, told apart by its bytes, is encoded once and its ids
are kept for the documents that hold it too (by each worker process, up to STORE_BYTES). Chunks are encoded in batches by
the library, which a memo of units (units.py) spares what it has encoded before: words are much fewer than chunks.

A cut may fall inside a word, so chunk joins are repaired: the stretch from a word before to a word after a torn one is
encoded again as a whole, and so are its parts in the first and the last chunk. If the chunks' ids end (begin) exactly with
those of the parts, and the whole begins (ends) with the same id, the parts' ids make way for those of the whole; while
anything disagrees, the stretch grows by a word on either side, at most to the whole row, and is encoded again. Stretches
that meet become one. No tokenizer here merges across white space, so what agrees is what encoding the whole text gives.

Null and empty texts give no tokens (and the hashes of an empty string). Repeated rows give repeated results, an empty
table none. Other columns are not read, whatever their names. Texts longer than BATCH_BYTES are taken in pieces that
end before white space; memory is bounded by a batch, the store, and the longest stretch without white space.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow_bytes, mix, spans_array, table, texts_at_a_time
from .token_counts import balanced
from .units import UnitMemo

WINDOW = 16
MASK = np.uint64(1023)
BATCH_BYTES = 1 << 20
STORE_BYTES = 128 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunk_cuts(buf: np.ndarray) -> np.ndarray:
    """Places, at starts of characters, where the rolling hash of the bytes before says to cut.

    The hash is a sum of rotated numbers of the bytes (cyclic polynomials); it only places cuts.
    """
    n = len(buf)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    number = _BYTE[buf]
    rolling = np.zeros(n - WINDOW, np.uint64)
    for k in range(WINDOW):
        x = number[k : n - WINDOW + k]
        rolling ^= x << np.uint64(k) | x >> np.uint64(64 - k) if k else x
    at = np.flatnonzero((mix(rolling) & MASK) == 0) + WINDOW
    return at[(buf[at] & 0xC0) != 0x80]


class ChunkEncoder:
    """Encodes rows of a buffer through a store of chunks. spaced: the tokenizer joins a space to the word after it."""

    def __init__(self, tok, spaced: bool = False, store_bytes: int = STORE_BYTES, memo: UnitMemo | None = None):
        self.tok, self.spaced, self.store_bytes, self.memo = tok, spaced, store_bytes, memo
        self.store: dict[bytes, np.ndarray] = {}
        self.seams: dict[tuple[bytes, bytes, bytes], list[np.ndarray]] = {}
        self.held = 0
        #: Chunks that did not have to be encoded; texts that were; joins that had to grow.
        self.reused = self.encoded = self.grown = 0

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        self.encoded += len(texts)
        if self.memo:
            if self.memo.full():
                self.memo.clear()
            return self.memo.encoded(texts)
        found = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, np.int32) for x in found]

    def rows(self, buf: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        if self.held > self.store_bytes:
            self.store.clear()
            self.seams.clear()
            self.held = 0
        raw = buf.tobytes()
        edges = np.unique(np.concatenate([bounds, chunk_cuts(buf)]))
        coded = spans_array(buf, edges[:-1], edges[1:]).dictionary_encode()
        keys, of = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        fresh = [k for k in keys if k not in self.store]
        self.reused += len(of) - len(fresh)
        for k, ids in zip(fresh, self.encode(fresh), strict=True):
            self.store[k] = ids
            self.held += len(k) + ids.nbytes + 200
        chunks = [self.store[keys[i]] for i in of.tolist()]
        inner = np.setdiff1d(edges, bounds)
        before, after = SPACE[buf[inner - 1]], SPACE[buf[inner]]
        torn = inner[~after | before | (buf[inner - 1] >= 128)] if self.spaced else inner[~before & ~after]
        front, back, put = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), {}
        for join in self.repaired(raw, bounds, torn, edges.tolist(), chunks):
            left, right = join.left, join.right
            back[left], front[right], put[right] = join.n_left, join.n_right, join.ids
            front[left + 1 : right] = [len(x) for x in chunks[left + 1 : right]]
        first = np.searchsorted(edges, bounds).tolist()
        out = []
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            parts = []
            for i in range(lo, hi):
                if i in put:
                    parts.append(put[i])
                parts.append(chunks[i][front[i] : len(chunks[i]) - back[i]])
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return out

    def repaired(self, raw: bytes, bounds: np.ndarray, torn: np.ndarray, edges: list[int], chunks: list[np.ndarray]) -> list[Join]:
        """The joins around torn cuts, encoded until they agree with the chunks on both sides."""
        of_row = (np.searchsorted(bounds, torn, side="right") - 1).tolist()
        limits = [(int(bounds[r]), int(bounds[r + 1])) for r in of_row]
        # The torn word and a word on either side.
        joins: list[Join] = []
        for c, (lo, hi) in zip(torn.tolist(), limits, strict=True):
            if joins and c < joins[-1].end and hi == joins[-1].hi:
                joins[-1].end = max(joins[-1].end, on_a_word(raw, on_a_word(raw, c, hi), hi))
            else:
                joins.append(Join(lo, hi, back_a_word(raw, back_a_word(raw, c, lo, self.spaced), lo, self.spaced), on_a_word(raw, on_a_word(raw, c, hi), hi)))
        while True:
            apart: list[Join] = []
            for j in joins:
                if apart and j.start < apart[-1].end and j.hi == apart[-1].hi:
                    apart[-1] = Join(j.lo, j.hi, min(apart[-1].start, j.start), max(apart[-1].end, j.end))
                else:
                    apart.append(j)
            joins, todo = apart, [j for j in apart if j.ids is None]
            if not todo:
                return joins
            keys = []
            for j in todo:
                j.left, j.right = bisect_right(edges, j.start) - 1, bisect_left(edges, j.end) - 1
                first, last = edges[j.left + 1], edges[j.right]
                keys.append((raw[j.start : first], raw[first:last], raw[last : j.end]))
            new = list({k for k in keys if k not in self.seams})
            coded = self.encode([x for a, mid, b in new for x in (a, b, a + mid + b)])
            for i, k in enumerate(new):
                self.seams[k] = coded[3 * i : 3 * i + 3]
                self.held += 3 * sum(map(len, k)) + 800
            for j, k in zip(todo, keys, strict=True):
                a, b, ids = self.seams[k]
                x, y = chunks[j.left], chunks[j.right]
                kept = np.array_equal(x[max(len(x) - len(a), 0) :], a) and np.array_equal(y[: len(b)], b)
                if kept and (j.start == j.lo or np.array_equal(ids[:1], a[:1])) and (j.end == j.hi or np.array_equal(ids[-1:], b[-1:])):
                    j.n_left, j.n_right, j.ids = len(a), len(b), ids
                else:
                    self.grown += 1
                    j.start, j.end = back_a_word(raw, j.start, j.lo, self.spaced), on_a_word(raw, j.end, j.hi)


@dataclass
class Join:
    """A stretch start:end of a row lo:hi, from the chunk numbered `left` to that numbered `right`."""

    lo: int
    hi: int
    start: int
    end: int
    left: int = 0
    right: int = 0
    #: How many ids of the two chunks make way, and for what.
    n_left: int = 0
    n_right: int = 0
    ids: np.ndarray | None = None


def back_a_word(raw: bytes, at: int, lo: int, spaced: bool) -> int:
    """The start of the word that ends at or before `at`, or of the white space before it if spaced."""
    while at > lo and SPACE[raw[at - 1]]:
        at -= 1
    while at > lo and not SPACE[raw[at - 1]]:
        at -= 1
    while spaced and at > lo and SPACE[raw[at - 1]]:
        at -= 1
    return at


def on_a_word(raw: bytes, at: int, hi: int) -> int:
    """The end of the word that begins at or after `at`."""
    while at < hi and SPACE[raw[at]]:
        at += 1
    while at < hi and not SPACE[raw[at]]:
        at += 1
    return at


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def worker_encoder(tokenizer: str, spaced: bool) -> ChunkEncoder:
    """The encoder of this worker process; tasks that run after each other go on with its store."""
    if (tokenizer, spaced) not in _encoders:
        memo = UnitMemo(tokenizer, spaced, cap=600_000)
        _encoders[tokenizer, spaced] = ChunkEncoder(memo.tok, spaced, memo=memo)
    return _encoders[tokenizer, spaced]


class Joined:
    """Hashes of a row's ids and tokens, each joined with a space, taken piece by piece."""

    def __init__(self):
        self.ids, self.tokens, self.n = sha256(), sha256(), 0

    def add(self, ids: bytes, tokens: bytes, n: int) -> None:
        if n:
            gap = b" " if self.n else b""
            self.ids.update(gap + ids)
            self.tokens.update(gap + tokens)
            self.n += n


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, and with_ids also ids and decoded.

    For tokenizers whose pattern drops white space and whose library decodes by joining tokens with spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, False)
        tok = encoder.tok
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        tokens, numbers = pa.array(names, pa.large_string()), pa.array([str(i) for i in range(len(names))], pa.large_string())
        for batch in texts_at_a_time(batches, 1):
            buf, offsets = arrow_bytes(batch.column(1))
            rows = [Joined() for _ in range(batch.num_rows)]
            held: list[list[np.ndarray]] = [[] for _ in rows]
            for part, bounds, at in balanced(buf, offsets, BATCH_BYTES):
                coded = encoder.rows(part, bounds)
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in coded])), pa.int64())
                flat = pa.array(np.concatenate(coded))
                text = [pc.binary_join(pa.LargeListArray.from_arrays(ends, x.take(flat)), pa.scalar(" ", pa.large_string())) for x in (numbers, tokens)]
                for row, ids, a, b in zip(at.tolist(), coded, *(x.cast(pa.large_binary()).to_pylist() for x in text), strict=True):
                    rows[row].add(a, b, len(ids))
                    if with_ids:
                        held[row].append(ids)
            columns = [batch.column(0), pa.array([r.n for r in rows], pa.int64()), pa.array([r.ids.hexdigest() for r in rows], pa.string()), pa.array([r.tokens.hexdigest() for r in rows], pa.string())]
            columns_of = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in held]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([tok.decode(x.tolist(), skip_special_tokens=False) for x in ids], pa.string())]
                columns_of += ["ids", "decoded"]
            yield pa.record_batch(columns, names=columns_of)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def op7_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
