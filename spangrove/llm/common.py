"""Tables, scratch space and byte-level text kernels that the operators of this folder share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """A folder under spark.checkpoint.dir for tables that cut lineage.

    Only where that setting is missing and the session runs within one machine (tests, notebooks) a folder of this
    machine is used; anywhere else that is an error, since executors would not see each other's files.
    """

    def __init__(self, spark: SparkSession, what: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.conf.get("spark.master", "")
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spangrove-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """df written and read again. Its shuffle files go with the write rather than stay until the driver collects
        garbage; the setting for that is as it was before when this returns."""
        path = f"{self.root}/{name}"
        schema = df.schema
        w = df.write.option("compression", "zstd")
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """df with a number for each row that stays the same whenever the frame is evaluated.

    Rows of files are cut into partitions the same way each time, so a plain scan is numbered as it is read; anything
    else is written first.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    operators = {line.strip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()}
    rows = df.withColumn(name, F.monotonically_increasing_id())
    return rows if operators <= {"Project", "Filter", "Relation"} else scratch.save(rows, f"rows-{uuid.uuid4().hex}")


def partitions(df: DataFrame, most: int = 32 << 20) -> int:
    """How many partitions to deal df to: as many as the session says, or more where the files hold more bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // most) if size < 1 << 56 else 0  # beyond: not known
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows with the one row of facts for each key; `count` says how many rows hold the key. how: inner, or left for rows
    without facts, whose keys must not be held by many.

    Keys of more than a fourth of a partition's share, at most four for each partition, are sent to the rows by
    broadcast; the rest meet in a shuffle, where no key is large. rows and facts are read several times: save them first.
    """
    most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = facts.where(F.col(count) > total / most).drop(count)  # fewer than `most` rows, since counts add up to total
    light = facts.where(F.col(count) <= total / most).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end what the allocators of this worker process hold unused goes back to the machine."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def rows_at_a_time(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts_at_a_time(batches: Iterator[pa.RecordBatch], at: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of the text in column `at`; a longer text stands alone."""
    for batch in batches:
        column = batch.column(at)
        if not batch.num_rows or column.buffers()[1] is None:
            yield batch
            continue
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        for i, j in slices(offsets, most):
            yield batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: \x20 and \x09-\x0D
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans_array(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The bytes of spans that follow each other without overlap."""
    lens = e - s
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    if total and total == int(e[-1] - s[0]):
        data = buf[s[0] : e[-1]]
    else:
        data = buf[np.repeat(s - (ends - lens), lens) + np.arange(total)] if total else buf[:0]
    wide = total >= 1 << 31
    offsets = np.append(0, ends).astype(np.int64 if wide else np.int32)
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def distinct_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, told apart by all their bytes, and for each span the place of its own among them."""
    coded = spans_array(buf, s, e).dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)


def keyed_hash(words: list[bytes], key: bytes = b"spangrove") -> np.ndarray:
    """64 bits of a cryptographic hash of each."""
    return np.frombuffer(b"".join([blake2b(w, digest_size=8, key=key).digest() for w in words]), np.uint64)


def arrow_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space; rows (and cuts) end a run."""
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    if cuts is not None:
        edges = np.concatenate([edges, cuts])
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row stands alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def pieces(buf: np.ndarray, offsets: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(row, start, end): rows whole, or cut before white space that follows another byte where longer than `most`."""
    out = []
    for row in range(len(offsets) - 1):
        s, e = int(offsets[row]), int(offsets[row + 1])
        while e - s > most:
            cut, lo = -1, s + 1
            while cut < 0 and lo < e:
                hi = min(e, lo + most)
                at = np.flatnonzero(SPACE[buf[lo:hi]] & ~SPACE[buf[lo - 1 : hi - 1]] & (buf[lo - 1 : hi - 1] < 128))
                if len(at):
                    cut = lo + int(at[-1] if lo == s + 1 else at[0])
                lo = hi
            if cut < 0:
                break
            out.append((row, s, cut))
            s = cut
        out.append((row, s, e))
    return out
