"""Simple-8b word-aligned coding of token ids, and token files in it.

Each 64-bit word has a selector in its top four bits and some values of equal width in the 60 bits below:

    selector   1   2   3   4   5   6   7   8   9  10  11  12  13  14  15
    values   120  60  30  20  15  12  10   8   7   6   5   4   3   2   1
    bits       0   1   2   3   4   5   6   7   8  10  12  15  20  30  60

Selector 0 is an escape: the next word holds one value of more than 60 bits as it is. The last word of a block may
have room for more values than are left; the block's count ends it.

A block is  b"S8B1" | count u32 | number of words u32 | stride u32 | offsets u32[ceil(count / stride)] | words u64[]
(little endian); offsets[i] is the word at which value i * stride starts, so blocks can be decoded from any stride.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_bytes, partitions, rows_at_a_time, table, texts_at_a_time
from .token_counts import BATCH_BYTES, balanced
from .units import shared_memo

# Fixed values of the format.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
STRIDE = 4096
MAGIC = b"S8B1"

_SELECTOR = np.zeros(256, np.uint8)
_SELECTOR[COUNTS[1:]] = np.arange(1, 16)
#: By the number of a value's bits: how many of its width fit in a word; 0 for an escape.
_FIT = np.array([max([c for c, b in zip(COUNTS[1:], BITS[1:], strict=True) if b >= n], default=0) for n in range(65)], np.uint8)


def _fits(values: np.ndarray) -> np.ndarray:
    if len(values) and int(values.max()) < 1 << 16:
        small = np.zeros(1 << 16, np.uint8)
        for n in range(17):
            small[(1 << n) >> 1 : 1 << n] = _FIT[n]
        return small[values]
    bits = np.zeros(len(values), np.int64)
    for n in range(64):
        bits += values >= np.uint64(1 << n)
    return _FIT[bits]


def encode_stride(values: np.ndarray) -> np.ndarray:
    """The words of one stride, which starts a word of its own."""
    n = len(values)
    fit = np.full(n + 190, 255, np.uint8)
    fit[:n] = _fits(values)
    windows = {1: fit}  # the least fit of 1, 2, 4, ... values from each place on
    for w in (2, 4, 8, 16, 32, 64):
        half = windows[w // 2]
        windows[w] = np.minimum(half[: len(half) - w // 2], half[w // 2 :])
    best = (fit[:n] > 0).astype(np.uint8)
    for w in COUNTS[14:0:-1].tolist():
        p = 1 << (w.bit_length() - 1)
        least = np.minimum(windows[p][:n], windows[p][w - p : w - p + n])
        best = np.where(least >= w, w, best).astype(np.uint8)
    counts, at, i = best.tobytes(), [], 0
    while i < n:
        at.append(i)
        i += counts[i] or 1
    at = np.array(at, np.int64)
    got = best[at]
    selector = np.where(got, _SELECTOR[got], 0).astype(np.int64)
    place = np.cumsum(1 + (selector == 0)) - 1 - (selector == 0)
    words = np.zeros(int(place[-1]) + 1 + int(selector[-1] == 0), np.uint64)
    words[place] = selector.astype(np.uint64) << np.uint64(60)
    padded = np.append(values, np.zeros(120, np.uint64))
    for k in np.unique(selector).tolist():
        mine = selector == k
        if k == 0:
            words[place[mine] + 1] = values[at[mine]]
        elif BITS[k]:
            packed = padded[at[mine][:, None] + np.arange(COUNTS[k])] << (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)
            words[place[mine]] |= np.bitwise_or.reduce(packed, axis=1)
    return words


def encode(values: np.ndarray) -> bytes:
    """A block of unsigned 64-bit values."""
    values = np.asarray(values).astype(np.uint64)
    parts = [encode_stride(values[i : i + STRIDE]) for i in range(0, len(values), STRIDE)]
    offsets = np.cumsum([0, *map(len, parts)])
    head = np.array([len(values), offsets[-1], STRIDE], "<u4").tobytes()
    return b"".join([MAGIC, head, offsets[:-1].astype("<u4").tobytes(), *(x.astype("<u8").tobytes() for x in parts)])


def decode(block: bytes) -> np.ndarray:
    """All values of a block, each selector's words at once."""
    if block[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    count, n_words, stride = np.frombuffer(block, "<u4", 3, 4).tolist()
    strides = -(-count // stride)
    offsets = np.append(np.frombuffer(block, "<u4", strides, 16).astype(np.int64), n_words)
    words = np.frombuffer(block, "<u8", n_words, 16 + 4 * strides)
    selector = (words >> np.uint64(60)).astype(np.int64)
    is_raw = np.zeros(n_words, bool)
    for i in np.flatnonzero(selector == 0).tolist():  # in order, since a raw word may look like an escape itself
        if not is_raw[i]:
            is_raw[i + 1] = True
    counts = np.where(is_raw, 0, COUNTS[selector])
    out = np.zeros(count + 120, np.uint64)
    ends = np.cumsum(counts)
    before = (ends - counts)[offsets[:-1]] if strides else np.zeros(0, np.int64)
    # Padding at the end of a stride is written over by the next stride.
    shift = np.repeat(np.arange(strides) * stride - before, np.diff(offsets))
    at = ends - counts + shift
    limit = np.repeat(np.minimum((np.arange(strides) + 1) * stride, count), np.diff(offsets))
    for k in range(16):
        mine = np.flatnonzero((selector == k) & ~is_raw)
        if not len(mine):
            continue
        if k == 0:
            out[at[mine]] = words[mine + 1]
            continue
        if not BITS[k]:
            continue
        lanes = np.arange(COUNTS[k])
        values = (words[mine][:, None] >> (lanes * BITS[k]).astype(np.uint64)) & np.uint64((1 << int(BITS[k])) - 1)
        where = at[mine][:, None] + lanes
        inside = where < limit[mine][:, None]
        out[where[inside]] = values[inside]
    return out[:count]


BLOCK_IDS = 1 << 19


def write_tokens(df: DataFrame, scratch: Scratch, tokenizer: str, spaced: bool, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files of all texts in ascending order of the id; a row is a block of whole documents.

    Null and empty texts hold no ids but the end id; rows that share an id follow each other by hashes of their texts,
    repeated rows included; a null id comes first. Other columns are not read, whatever their names. An empty table gives
    no blocks. A text of any length is encoded in pieces of BATCH_BYTES; its ids are held by one task.
    Columns: shard (ascending through the files), before (ids of the shard before this block), n_ids, doc_ids, lens,
    payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before = TaskContext.get().partitionId(), 0
        memo = shared_memo(tokenizer, spaced)
        docs: list = []
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            all_lens = np.concatenate(lens)
            payload = encode(np.concatenate(ids)) if ids else encode(np.zeros(0, np.uint64))
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([int(all_lens.sum())], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([all_lens], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["shard", "before", "n_ids", "doc_ids", "lens", "payload"])

        for batch in texts_at_a_time(batches, 1):
            buf, offsets = arrow_bytes(batch.column(1))
            got: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for part, bounds, rows in balanced(buf, offsets, BATCH_BYTES):
                s, e = memo.spans(part, bounds)
                if len(s):
                    slots = memo.slots(part, s, e)
                    flat = memo.ids(slots)
                    ends = np.append(0, np.cumsum(memo.lens[slots]))[np.searchsorted(s, bounds)]
                    for k, row in enumerate(rows.tolist()):
                        got[row].append(flat[ends[k] : ends[k + 1]])
                if memo.full():
                    memo.clear()
            tail = [np.array([end_id], np.int32)] if end_id is not None else []
            for doc, x in zip(batch.column(0).to_pylist(), got, strict=True):
                x = x + tail
                docs.append(doc)
                lens.append(np.array([sum(map(len, x))], np.int64))
                ids += x
                held += int(lens[-1][0])
                if held >= BLOCK_IDS:
                    yield flush()
                    before, held = before + held, 0
                    docs, lens, ids = [], [], []
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "text_hash", "row"]  # an id that many rows hold does not meet in one task
    ordered = rows.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.save(ordered.mapInArrow(run, "shard int, before long, n_ids long, doc_ids array<long>, lens array<long>, payload binary"), "tokens")


def read_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document of the token files.

    Only sums per shard, of which there are as many as files, meet in one task.
    """
    sums = tokens.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = sums.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    # As many rows as files, which are as many as shuffle partitions.
    placed = tokens.join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 1):
            for start, docs, lens, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = decode(payload).astype("<u4").tobytes()
                ends = np.cumsum(lens)
                begins = ends - lens
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + begins), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("start", "doc_ids", "lens", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """byte_bpe_50k.json, id 2 at the end of each document."""
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), "byte_bpe_50k.json", spaced=True, end_id=2))
