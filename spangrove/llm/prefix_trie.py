"""The trie of conversation prefixes: turn arrays sorted over all partitions, LCPs of neighbours, one stack for each.

1. A turn becomes 16 bytes of the SHA-256 of its role and text, and the number of its words; a conversation the joined
   digests of its turns, so that byte order is an order of turn arrays in which a prefix comes first. Texts are read
   by the scan alone.
2. The arrays are sorted by ranges over all partitions (copies of one array by conv_id, so a third of all rows of one
   array spreads over many partitions).
3. Each partition goes through its rows once with a stack of open nodes. The LCP with the row before says which nodes
   close; what a closed node holds (members, leaves, savings) goes to the node below it.
4. Nodes on the path of a partition's first or last row may reach into its neighbours. These open stacks, two paths
   for each partition, go in order through a second sweep of the same kind, which matches them digest by digest.
5. A child learns its parent's smallest member by a join on the parent's id. Ids belong to one partition, so the
   children of a node that spans many partitions meet in as many groups.

Memory: one stack for each task (the longest conversation), and the ids of the row's equals within a partition. The
stitching task reads two stacks for each partition. A digest of members is SHA-256 over their ids in order, which is
sequential: ids of one array that spans partitions stream through one task, 8 bytes each, sorted by Spark.

Rows without a conv_id take no part. A null role or text is empty, a null turn comes first; rows that share a
conversation and a turn are ordered by their digests, repeated rows stay. Conversations of any number of turns and turns
of any length are one row of 20 bytes a turn. An empty table has no nodes. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, rows_at_a_time, table

WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"
FLUSH = 1 << 14
NOTHING = sha256(b"").hexdigest()


def turn_arrays(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns, an array of (turn, digest, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH)
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def rebuilt(arrays: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the first conversation of their group, h = crc32(conv_id) % most."""
    heads = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    mine = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    none = F.array().cast(arrays.schema["turns"].dataType)
    shared = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return mine.join(heads, "base", "left").select("conv_id", F.concat(shared, own).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two arrays share at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("id", "depth", "digest", "words", "conv", "n", "children", "leaves", "saved", "ends", "first")

    def __init__(self, id_: int, depth: int, digest: bytes, words: int, first: bool = False):
        self.id, self.depth, self.digest, self.words, self.first = id_, depth, digest, words, first
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] | str | None = None

    def add(self, conv: int | None, n: int) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.n += n

    def close(self, below: Node | None) -> None:
        """All of the node's rows are known: what it holds goes to the node below it, its parent."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words
        if below:
            below.children += 1
            below.leaves += self.leaves
            below.saved += self.saved


#: node: closed; path: open, of the partition's first (side 0) or last (1) row; run: a member that ends there; same: id is another's.
SCHEMA = "kind string, part int, side int, id long, parent long, depth long, digest binary, words long, conv_id long, n long, children long, leaves long, saved long, ends string"
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 6, pa.string()]
_NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]


class Rows:
    """Rows of SCHEMA, handed on as batches."""

    def __init__(self, part: int):
        self.part, self.rows = part, []

    def node(self, kind: str, side: int, x: Node, parent: int | None, blank: bool = False) -> None:
        ends = x.ends if isinstance(x.ends, str) else None
        held = (None, 0, 0, 0, 0, None) if blank else (x.conv, x.n, x.children, x.leaves, x.saved, ends)
        self.rows.append((kind, self.part, side, x.id, parent, x.depth, x.digest, x.words, *held))

    def run(self, x: Node, conv: int) -> None:
        self.rows.append(("run", self.part, 0, x.id, None, x.depth, None, 0, conv, 0, 0, 0, 0, None))

    def same(self, id_: int, as_: int) -> None:
        self.rows.append(("same", self.part, 0, id_, as_, 0, None, 0, None, 0, 0, 0, 0, None))

    def flush(self, least: int = FLUSH) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= max(least, 1):
            columns = list(zip(*self.rows, strict=True))
            self.rows = []
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed nodes, open paths and members that end on them, of sorted rows (key, conv_id, words)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out, stack, path, before, made = Rows(part), [], [], None, part << 40

    def pop() -> None:
        x = stack.pop()
        below = stack[-1] if stack else None
        if below:
            below.add(x.conv, x.n)
        if x.first:
            path.append(x)
            return
        if x.ends:
            x.ends = sha256(",".join(map(str, x.ends)).encode()).hexdigest()
        x.close(below)
        out.node("node", 0, x, below.id if below else None)

    for batch in batches:
        for key, conv, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            depth = len(key) // WIDTH
            shared = -1 if before is None else common(before, key)
            while len(stack) > shared + 1:
                pop()
            for d in range(shared + 1, depth + 1):
                stack.append(Node(made, d, key[(d - 1) * WIDTH : d * WIDTH] if d else b"", words[d - 1] if d else 0, before is None))
                made += 1
            top = stack[-1]
            top.add(conv, 1)
            if top.ends is None:
                top.ends = []
            top.ends.append(conv)
            before = key
            yield from out.flush()
    if before is None:
        return
    last = list(stack)
    while stack:  # what is still open
        x = stack.pop()
        if stack:
            stack[-1].add(x.conv, x.n)
        if x.first:
            path.append(x)
    path.sort(key=lambda x: x.depth)
    tops = [path[-1]] if last[-1].first else [path[-1], last[-1]]
    for x in tops:
        for conv in x.ends or ():
            out.run(x, conv)
            yield from out.flush()
        x.ends = None
    for side, nodes in enumerate([path, last][: len(tops)]):
        for x in nodes:
            if isinstance(x.ends, list):
                x.ends = sha256(",".join(map(str, x.ends)).encode()).hexdigest()
            out.node("path", side, x, None, blank=side == 1 and x.first)
            yield from out.flush()
    yield from out.flush(1)


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of open paths, which come in the order of (part, side, depth), and which ids are the same node."""
    out, stack, matching = Rows(0), [], True

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            below = stack[-1] if stack else None
            x.close(below)
            out.node("node", 0, x, below.id if below else None)

    length = 0  # of the path so far
    for batch in batches:
        for r in batch.to_pylist():
            d = r["depth"]
            if d == 0:
                pop_to(length)
                matching = True
            if matching and (d >= len(stack) or stack[d].digest != r["digest"]):
                pop_to(d)
                matching = False
            if not matching:
                stack.append(Node(r["id"], d, r["digest"], r["words"]))
            x, length = stack[d], d + 1
            if r["n"]:
                x.add(r["conv_id"], r["n"])
                x.children, x.leaves, x.saved = x.children + r["children"], x.leaves + r["leaves"], x.saved + r["saved"]
                x.ends = r["ends"] or x.ends
                out.same(r["id"], x.id)
            yield from out.flush()
    pop_to(0)
    yield from out.flush(1)


def hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and SHA-256 of its members, of rows (id, conv_id) in order; ids are streamed, never held."""
    at, h = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for id_, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if id_ == at:
                h.update(b",%d" % conv)
                continue
            if h:
                done.append((at, h.hexdigest()))
            at, h = id_, sha256(b"%d" % conv)
        yield pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["id", "run"])
    if h:
        yield pa.record_batch([pa.array([at], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["id", "run"])


def trie(arrays: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    arrays: conv_id, each once, and turns, an array of structs with digest (WIDTH bytes) and words.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    keyed = scratch.save(arrays.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words")), "keys")
    ordered = keyed.repartitionByRange(partitions(keyed), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.save(ordered.mapInArrow(lambda it: sweep(b for x in it for b in rows_at_a_time([x], 4096)), SCHEMA), "swept", "kind")
    paths = swept.where("kind = 'path'").repartition(1).sortWithinPartitions("part", "side", "depth")
    stitched = scratch.save(paths.mapInArrow(stitch, SCHEMA), "stitched", "kind")
    same = stitched.where("kind = 'same'").select("id", F.col("parent").alias("node"))
    runs = swept.where("kind = 'run'").select("id", "conv_id").join(same, "id").select(F.col("node").alias("id"), "conv_id")
    ends = runs.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(hashed_runs, "id long, run string")
    mine = ["id", "parent", "depth", "conv_id", "n", "children", "leaves", "saved"]
    open_ = scratch.save(stitched.where("kind = 'node'").join(ends, "id", "left").select(*mine, F.coalesce("run", "ends").alias("ends")), "open")
    closed = swept.where("kind = 'node'")
    parents = closed.where("children > 0").select("id", "conv_id").unionByName(same.join(open_.select(F.col("id").alias("node"), "conv_id"), "node").select("id", "conv_id"))
    nodes = closed.select(*mine, "ends").unionByName(open_)
    of = parents.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(of, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all conversations, rebuilt so that those of a group of 20 share up to three first turns."""
    return trie(rebuilt(turn_arrays(table(spark, sf_dir, "conversations"))), Scratch(spark, "op11"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
SQL11 = rf"""
WITH t AS (SELECT conv_id, turn, left(sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))), 32) AS d,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(w ORDER BY turn NULLS FIRST, d) AS ws, {_CRC.format("any_value(CAST(conv_id AS VARCHAR))")} % 4 AS h FROM t GROUP BY conv_id),
  r AS (SELECT o.conv_id, list_concat(coalesce(b.ds, [])[:o.h], o.ds[o.h + 1:]) AS ds, list_concat(coalesce(b.ws, [])[:o.h], o.ws[o.h + 1:]) AS ws FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
  m AS (SELECT conv_id, unnest(range(0, len(ds) + 1)) AS depth, ds, ws FROM r),
  g AS (SELECT depth, md5(array_to_string(ds[:depth], ',')) AS id, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN depth > 0 THEN md5(array_to_string(ds[:depth - 1], ',')) END) AS parent,
    any_value(CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ds) = depth), '')) AS ends FROM m GROUP BY 1, 2),
  c AS (SELECT parent AS id, depth - 1 AS depth, count(*) AS children FROM g WHERE depth > 0 GROUP BY 1, 2),
  s AS (SELECT a.depth, md5(array_to_string(m.ds[:a.depth], ',')) AS id, count(*) FILTER (c.children IS NULL) AS leaves, sum((g.n - 1) * g.w) AS saved
    FROM g LEFT JOIN c USING (id, depth) JOIN m ON m.conv_id = g.conv_id AND m.depth = g.depth, LATERAL (SELECT unnest(range(0, g.depth + 1)) AS depth) a GROUP BY 1, 2)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
FROM g LEFT JOIN c USING (id, depth) JOIN s USING (id, depth) LEFT JOIN g p ON p.id = g.parent AND p.depth = g.depth - 1
"""
