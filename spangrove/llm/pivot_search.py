"""Exact top-k inner products by pivot-table elimination.

Vectors are quantised to floor(256 x). Their distances to PIVOTS pivots (the rows with the smallest hashes of their
ids) are stored with them. For a query q and a candidate v, the largest |d(q, p) - d(v, p)| over the pivots p bounds
d(q, v) from below, hence their inner product (|q|^2 + |v|^2 - d(q, v)^2) / 2 from above. Candidates are evaluated in
the order of their bounds until the next bound is below the k-th best score so far.

Vectors are sorted by their nearest pivots and cut into blocks of alike ones, with the range of each pivot's distances.
A query first meets its own block, without a shuffle, which gives it k scores to start from. Queries of neighbouring
blocks make a pack, with ranges as well; the same bound on ranges tells which blocks a pack needs at all, before any vector
moves. Only those blocks are sent, each once for each such pack, in groups that get the pack's queries once.

Vectors that are null or hold a null, NaN or infinite component take no part, nor do those of a length unlike the
query's. Ties go to the smaller id. Only the query's own row is left out, so a repeated row finds its twins; a null id
takes no part. An empty table gives no rows; other columns are not read, whatever their names. Sums beyond 2**53 are
computed with Python's integers. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, rows_at_a_time, table

PIVOTS = 32
BLOCK = 2048
PACK = 2048
GROUP = 8
STEP = 256


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, pivots = v.astype(float), pivots.astype(float)
    squared = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def upper(squares: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A bound of inner products from sums of squared lengths and a bound of distances, rounding errors allowed for."""
    return (squares - np.maximum(lower, 0) ** 2) / 2 + 1e-6 * squares + 0.5


def bounds(q: np.ndarray, qd: np.ndarray, v: np.ndarray, vd: np.ndarray) -> np.ndarray:
    """An upper bound of each inner product."""
    lower = np.zeros((len(q), len(v)))
    for p in range(qd.shape[1]):
        np.maximum(lower, np.abs(qd[:, p, None] - vd[None, :, p]), out=lower)
    squares = (q.astype(float) ** 2).sum(axis=1)[:, None] + (v.astype(float) ** 2).sum(axis=1)[None]
    return upper(squares, lower)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact v @ q as integers."""
    if not len(v) or not v.shape[1] or float(np.abs(q).max()) * float(np.abs(v).max()) * v.shape[1] < 2.0**53:
        return (v.astype(float) @ q.astype(float)).astype(np.int64)
    return np.array([int(sum(a * b for a, b in zip(row, q.tolist(), strict=True))) for row in v.tolist()], object).astype(np.int64)


class Best:
    """The k best of each query: (score with its sign turned, id, whether it is new here)."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, q: np.ndarray, qd: np.ndarray, k: int):
        self.rids, self.ids, self.q, self.qd, self.k = rids, ids, q, qd, k
        self.top: list[list[tuple[int, int, bool]]] = [[] for _ in rids]
        self.evaluated = 0

    def take(self, rids: np.ndarray, ids: np.ndarray, v: np.ndarray, vd: np.ndarray, skip: np.ndarray | None = None) -> None:
        """Candidates for all queries but those of `skip`."""
        every = np.arange(len(self.q)) if skip is None else np.flatnonzero(~skip)
        high = bounds(self.q[every], self.qd[every], v, vd)
        high[self.rids[every][:, None] == rids[None]] = -np.inf
        for i, mine in zip(every.tolist(), high, strict=True):
            top = self.top[i]
            alive = np.flatnonzero(mine >= -top[-1][0] if len(top) == self.k else mine > -np.inf)
            alive = alive[np.argsort(-mine[alive], kind="stable")]
            for at in range(0, len(alive), STEP):
                some = alive[at : at + STEP]
                if len(top) == self.k and mine[some[0]] < -top[-1][0]:
                    break
                scores = products(self.q[i], v[some])
                self.evaluated += len(some)
                if len(top) == self.k:
                    good = scores >= -top[-1][0]
                    some, scores = some[good], scores[good]
                if len(some) > self.k:
                    order = np.lexsort((ids[some], -scores))[: self.k]
                    some, scores = some[order], scores[order]
                top = sorted([*top, *((s, x, True) for s, x in zip((-scores).tolist(), ids[some].tolist(), strict=True))])[: self.k]
            self.top[i] = top


def narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    most = int(np.abs(v).max()) if v.size else 0
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def pack(v: np.ndarray) -> bytes:
    return v.dtype.char.encode() + v.tobytes()


def unpack(b: bytes, rows: int) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    return np.frombuffer(b[1:], kind).astype(np.int64 if kind.kind == "i" else kind).reshape(rows, -1)


BLOCKS = "kind string, block long, dim int, n long, rids binary, ids binary, v binary, d binary, home binary, tops array<struct<at:int,score:long,id:long>>, lo array<double>, hi array<double>, norm double, floor double"


def component(x: Column) -> Column:
    """floor(256 x); an error where that leaves 64 bits, which a cast would clip in silence."""
    y = F.floor(x.cast("double") * 256)
    far = F.abs(x.cast("double") * 256) >= 2.0**63
    return F.when(far, F.raise_error(F.lit("a component leaves 64 bits")).cast("long")).otherwise(y.cast("long"))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """rid, id, v, is_query of the vectors that take part."""
    v = F.col(vector_col)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(whole & F.col(id_col).isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.transform(v, component).alias("v"), is_query.alias("is_query"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors (column v), the rows and the matrix."""
    column = batch.column("v")
    lens = np.diff(np.asarray(column.offsets))
    flat, begins = np.asarray(column.flatten()), np.cumsum(lens) - lens
    for dim in np.unique(lens).tolist():
        mine = np.flatnonzero(lens == dim)
        yield mine, flat[begins[mine][:, None] + np.arange(dim)]


def prepare(vectors: DataFrame, scratch: Scratch, id_col: str, vector_col: str, is_query: Column, k: int) -> DataFrame:
    """BLOCKS: blocks of alike vectors (kind b) and packs of queries (kind q) with their best in their own blocks."""
    rows = quantised(vectors, id_col, vector_col, is_query)
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).select("v").collect()
    pivots_of = lambda dim: np.array([r.v for r in chosen if len(r.v) == dim], np.int64).reshape(-1, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 4096):
            for mine, m in matrices(batch):
                d = distances(m, pivots_of(m.shape[1]))
                order = np.argsort(d, axis=1, kind="stable")[:, :2]
                near = np.hstack([order, np.full((len(m), 2 - order.shape[1]), -1)])
                close = d[np.arange(len(m)), order[:, 0]] if d.shape[1] else np.zeros(len(m))
                taken = [batch.column(c).take(pa.array(mine)) for c in ("rid", "id", "v", "is_query")]
                yield pa.record_batch([*taken, pa.array(np.full(len(m), m.shape[1], np.int32)), pa.array(near[:, 0]), pa.array(near[:, 1]), pa.array(close)], names=["rid", "id", "v", "is_query", "dim", "near", "next", "close"])

    placed = rows.mapInArrow(place, "rid long, id long, v array<long>, is_query boolean, dim int, near long, next long, close double")
    order = ["dim", "near", "next", "close", "rid"]
    dealt = placed.repartitionByRange(partitions(vectors), *order).sortWithinPartitions(*order).select("rid", "id", "v", "is_query")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        queries: list[tuple] = []

        def row(kind: str, block: int, rids, ids, m, d, home, tops, floor: float) -> pa.RecordBatch:
            norm = float((m.astype(float) ** 2).sum(axis=1).max())
            values = [kind, block, m.shape[1], len(m), rids.tobytes(), ids.tobytes(), pack(narrow(m)), pack(d), home, tops, d.min(axis=0).tolist(), d.max(axis=0).tolist(), norm, floor]
            return pa.RecordBatch.from_pylist([dict(zip(arrow_schema.names, values, strict=True))], schema=arrow_schema)

        def flush() -> pa.RecordBatch:
            rids, ids, m, d, home = (np.concatenate([x[i] for x in queries]) for i in range(5))
            tops = [t for x in queries for t in x[5]]
            floor = min(float(-t[-1][0]) if len(t) == k else -np.inf for t in tops)
            return row("q", int(home[0]), rids, ids, m, d, home.tobytes(), [{"at": i, "score": -s, "id": x} for i, t in enumerate(tops) for s, x, _ in t], floor)

        for batch in rows_at_a_time(batches, BLOCK):
            rids, ids, query = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False)
            for mine, m in matrices(batch):
                d = distances(m, pivots_of(m.shape[1]))
                yield row("b", number, rids[mine], ids[mine], m, d, None, None, -np.inf)
                some = np.flatnonzero(query[mine])
                if len(some):
                    own = mine[some]
                    best = Best(rids[own], ids[own], m[some], d[some], k)
                    best.take(rids[mine], ids[mine], m, d)
                    if queries and queries[0][2].shape[1] != m.shape[1]:
                        yield flush()
                        queries = []
                    queries.append((rids[own], ids[own], m[some], d[some], np.full(len(own), number), best.top))
                    if sum(len(x[0]) for x in queries) >= PACK:
                        yield flush()
                        queries = []
                number += 1
        if queries:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    return scratch.save(dealt.mapInArrow(build, BLOCKS), "blocks", "kind")


def needed(blocks: DataFrame) -> DataFrame:
    """pack, block: the blocks that may hold a result for a query of a pack, by the ranges of their distances."""
    ranges = blocks.select("kind", "block", "dim", "lo", "hi", "norm", "floor")
    sheets = ranges.where("kind = 'b'").withColumn("sheet", F.expr("block >> 32").cast("int"))
    sheets = sheets.groupBy("dim", "sheet").agg(F.collect_list(F.struct("block", "lo", "hi", "norm")).alias("sheet_rows"))
    ids = sheets.select("dim", "sheet").groupBy("dim").agg(F.collect_list("sheet").alias("sheets"))
    packs = ranges.where("kind = 'q'").select("dim", F.col("block").alias("pack"), "lo", "hi", "norm", "floor").join(ids, "dim").withColumn("sheet", F.explode("sheets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 16):
            for r in batch.to_pylist():
                lo, hi = (np.array([x[c] for x in r["sheet_rows"]]).reshape(len(r["sheet_rows"]), -1) for c in ("lo", "hi"))
                apart = np.maximum(lo - np.array(r["hi"]), np.array(r["lo"]) - hi)
                squares = np.array([x["norm"] for x in r["sheet_rows"]]) + r["norm"]
                keep = np.flatnonzero(upper(squares, apart.max(axis=1, initial=0)) >= r["floor"])
                yield pa.record_batch([pa.array(np.full(len(keep), r["pack"], np.int64)), pa.array([r["sheet_rows"][i]["block"] for i in keep.tolist()], pa.int64())], names=["pack", "block"])

    return packs.select("pack", "lo", "hi", "norm", "floor", "dim", "sheet").join(sheets, ["dim", "sheet"]).mapInArrow(run, "pack long, block long")


def search(vectors: DataFrame, scratch: Scratch, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score."""
    blocks = prepare(vectors, scratch, id_col, vector_col, is_query, k)
    pairs = scratch.save(needed(blocks), "pairs")
    groups = pairs.groupBy("pack").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    pairs = pairs.join(groups, "pack").withColumn("g", F.pmod(F.xxhash64("block"), "groups").cast("int"))
    columns = ["n", "rids", "ids", "v", "d", "home", "tops"]
    packs = blocks.where("kind = 'q'").select(F.col("block").alias("pack"), *columns)
    asked = packs.join(groups, "pack").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("pack", "g", F.lit(-1).cast("long").alias("block"), *columns)
    sent = blocks.where("kind = 'b'").select("block", *columns).join(pairs, "block").select("pack", "g", "block", *columns)
    met = asked.unionByName(sent).repartition(partitions(vectors), "pack", "g").sortWithinPartitions("pack", "g", "block")

    def found(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["rid", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = best = None
        new = lambda: found([(int(r), int(i), x, -s) for r, i, top in zip(best.rids, best.ids, best.top, strict=True) for s, x, fresh in top if fresh])
        for batch in rows_at_a_time(batches, 1):
            r = batch.to_pylist()[0]
            rids, ids = np.frombuffer(r["rids"], np.int64), np.frombuffer(r["ids"], np.int64)
            v, d = unpack(r["v"], r["n"]), unpack(r["d"], r["n"])
            if (r["pack"], r["g"]) != now:  # the queries come first
                if best:
                    yield new()
                now, home = (r["pack"], r["g"]), np.frombuffer(r["home"], np.int64)
                best = Best(rids, ids, v, d, k)
                for x in r["tops"]:
                    best.top[x["at"]].append((-x["score"], x["id"], False))
            else:
                best.take(rids, ids, v, d, home == r["block"])
        if best:
            yield new()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 1):
            r = batch.to_pylist()[0]
            rids, ids = np.frombuffer(r["rids"], np.int64), np.frombuffer(r["ids"], np.int64)
            yield found([(int(rids[x["at"]]), int(ids[x["at"]]), x["id"], x["score"]) for x in r["tops"]])

    schema = "rid long, query_id long, vec_id long, score long"
    every = met.mapInArrow(run, schema).unionByName(packs.select("rids", "ids", "tops").mapInArrow(first, schema))
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"), F.pmod("vec_id", F.lit(50)) == 0)


SQL8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
