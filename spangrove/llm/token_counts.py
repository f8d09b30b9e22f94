"""Token counts: Arrow functions that return lengths only.

Texts longer than PIECE_BYTES are split at safe boundaries (white space after another character, where the tokenizers'
patterns always end a piece), and the pieces go to the library in batches of about BATCH_BYTES. Ids never leave
the function. Byte-level tokenizers join one space to the word after it; a piece begins with its white space, so this
holds across cuts.

Null and empty texts have 0 tokens and 0 bytes. Equal rows give equal rows, an empty table none. Other columns are not
read, whatever their names. Memory is bounded by BATCH_BYTES of text, or by the longest stretch without ASCII white
space where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, pieces, slices, table, texts_at_a_time
from .units import load_tokenizer

BATCH_BYTES = 1 << 20
#: The library takes pieces of about this size fastest.
PIECE_BYTES = 1 << 10
KNOWN_BYTES = 64 << 20


def balanced(buf: np.ndarray, offsets: np.ndarray, most: int, piece: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets of pieces, row of each piece) of about `most` bytes at a time, pieces of `piece` at most if given."""
    cut = pieces(buf, offsets, piece or most)
    if not cut:
        return
    rows, starts, ends = (np.array(x, np.int64) for x in zip(*cut, strict=True))
    bounds = np.append(starts, ends[-1])
    for i, j in slices(bounds, most):
        yield buf[starts[i] : ends[j - 1]], bounds[i : j + 1] - starts[i], rows[i:j]


class Counter:
    """Counts pieces; equal ones, which copies of documents have, once while they are remembered."""

    def __init__(self, tok, most: int = KNOWN_BYTES):
        self.tok, self.most, self.held = tok, most, 0
        self.known: dict[bytes, int] = {}

    def lengths(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece, from one call of the library."""
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        raw = buf.tobytes()
        texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        new = list(dict.fromkeys(t for t in texts if t not in self.known))
        found = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in new], add_special_tokens=False)
        self.known.update(zip(new, map(len, found), strict=True))
        self.held += sum(map(len, new)) + 150 * len(new)
        return np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))


_counters: dict[str, Counter] = {}


def worker_counter(name: str) -> Counter:
    """The counter of this worker process."""
    if name not in _counters:
        _counters[name] = Counter(load_tokenizer(name))
    return _counters[name]


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer)
        for batch in texts_at_a_time(batches, 1):
            buf, offsets = arrow_bytes(batch.column(1))
            counts = np.zeros(batch.num_rows, np.int64)
            for part, bounds, rows in balanced(buf, offsets, BATCH_BYTES, PIECE_BYTES):
                np.add.at(counts, rows, counter.lengths(part, bounds))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
