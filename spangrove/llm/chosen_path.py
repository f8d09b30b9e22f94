"""N-gram Jaccard join by chosen paths: all pairs of documents whose sets of word 5-grams have a similarity of 0.8.

Words are the runs between ASCII white space with A-Z made small; a text of one to four words has one shingle, all its
words; a text without words links to nothing. Documents with equal sets form a class at once, and one of each class,
its representative, goes on.

Chosen paths: in each run the representatives are split by a sampled token of their sets (the minimum under a hash of
the run, which two sets share with a probability that equals their similarity). A bucket of more than SMALL members is
split again by a fresh sample, up to DEPTH times, unless its members agree so often that they are mostly alike (the
pairs that stay together are at least half of all), in which case splitting would not part them.

Runs come in rounds of ROUND. A pair of similarity s meets in a run with probability s**depth of its bucket at least, so
each pair found after R runs stands for (1 - s**depth)**R / (1 - (1 - s**depth)**R) pairs that were missed. Rounds are
added until found / (found + missed) reaches RECALL, or until the MOST_RUNS-th run, by when even pairs at 0.8 in buckets
of the last depth are found with that probability.

Stars: each representative of a bucket of more than SMALL members is compared with the bucket's centre, the member with
most company over all runs. Those at 0.9 or more are the star's core. The Jaccard distance is a metric, so two of one
core are linked, which their number tells without comparing them. This is what keeps a group of m near copies from
costing m * m comparisons.

Buckets are compared by brute force with exact similarities, as integers, of pairs that aren't in one core. Buckets with
equal members are compared once. Buckets of more than BLOCK members are cut into blocks, cores apart from the rest, and
blocks that may hold links meet in tasks of their own, so no task holds more than two blocks. A pair that shares several
buckets is counted in the first. What leaves a task is a row for each member: how many documents it links to, and the
least member of its connected part. These, and the spokes of the stars, are joined into components by alternating
large-star and small-star steps.

Sets that meet only through hashes: shingles are told apart across tasks by 64 bits made from a keyed cryptographic
hash of each word, equal sets by two sums of such numbers (128 bits) and their size. Within a task words are told apart
by their bytes. Null and empty texts have no links. Rows that repeat, or share an id, or have none, are rows of their
own. Other columns are not read. Texts of any length are taken whole; memory is bounded by two blocks of BLOCK_SHINGLES
or by the two longest texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, Scratch, arrow_bytes, clear_name, distinct_spans, join_facts, keyed_hash, mix, numbered, partitions, rows_at_a_time, slices, table, texts_at_a_time, word_spans

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.995
DEPTH = 3
ROUND = 4
#: Enough for RECALL at SIMILARITY in buckets of the last depth, whatever was measured.
MOST_RUNS = -(-math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY**DEPTH)) // ROUND) * ROUND
SMALL = 256
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
SLICE_BYTES = 2 << 20

_C = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = mix(np.arange(1, MOST_RUNS * DEPTH + 1, dtype=np.uint64) * _C) | np.uint64(1)
_ADDENDS = mix(np.arange(1001, MOST_RUNS * DEPTH + 1001, dtype=np.uint64) * _C)


def own_names(words: list[bytes]) -> np.ndarray:
    """Numbers that tell words apart within one task."""
    return mix(np.arange(1, len(words) + 1, dtype=np.uint64))


def shingles(buf: np.ndarray, offsets: np.ndarray, names: Callable[[list[bytes]], np.ndarray] = keyed_hash) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    small = LOWER[buf]
    s, e = word_spans(small, offsets)
    words, of = distinct_spans(small, s, e)
    flat = names(words)[of] if len(words) else np.zeros(0, np.uint64)
    first = np.searchsorted(s, offsets)
    m = max(len(flat) - WORDS + 1, 0)
    joined = flat[:m]
    for k in range(1, WORDS):
        joined = mix(joined) * _C + flat[k : k + m]
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            x = np.sort(joined[a : b - WORDS + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for w in range(a, b):
                short = mix(short) * _C + flat[w]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints of each set, and the sampled tokens of all runs and depths; zeros for an empty set."""
    n = np.array([len(x) for x in sets])
    some = np.flatnonzero(n)
    fp, tokens = np.zeros((2, len(sets)), np.uint64), np.zeros((len(sets), MOST_RUNS * DEPTH), np.uint64)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        begins = np.cumsum(n[some]) - n[some]
        for i in range(2):
            fp[i, some] = np.add.reduceat(mix(flat + np.uint64(i + 1)), begins)
        for k in range(MOST_RUNS * DEPTH):
            h = (flat ^ _ADDENDS[k]) * _MULTIPLIERS[k]
            tokens[some, k] = np.minimum.reduceat(h, begins)
    return fp[0], fp[1], tokens


def sets_of(texts: DataFrame) -> DataFrame:
    """rid, doc_id, n (size of the set), fp1, fp2, tokens from rid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_at_a_time(batches, 2, SLICE_BYTES):
            sets = shingles(*arrow_bytes(batch.column(2)))
            a, b, tokens = sketch(sets)
            packed = pa.array([x.tobytes() for x in tokens], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), packed], names=["rid", "doc_id", "n", "fp1", "fp2", "tokens"])

    return texts.mapInArrow(run, "rid long, doc_id long, n long, fp1 long, fp2 long, tokens binary")


def paths(reps: DataFrame, scratch: Scratch, runs: range, small: int) -> DataFrame:
    """rep, n, run, key, depth: the bucket, of two members or more, in which each representative ends in each run."""
    tag = f"{runs.start}"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(rep), MOST_RUNS, DEPTH)
            for r in runs:
                key = mix(tokens[:, r, 0] + _ADDENDS[r])
                rest = pa.array([x.tobytes() for x in tokens[:, r, 1:]], pa.binary())
                yield pa.record_batch([pa.array(rep), pa.array(n), pa.array(np.full(len(rep), r, np.int32)), pa.array(key.view(np.int64)), rest], names=["rep", "n", "run", "key", "rest"])

    rows = reps.select("rep", "n", "tokens").mapInArrow(start, "rep long, n long, run int, key long, rest binary")
    # Singletons, nearly all, go before anything is written.
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    open_ = scratch.save(rows.join(sizes, "key"), f"depth1-{tag}")
    out = None
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH
        stay = (open_ if last else open_.where(F.col("size") <= small)).select("rep", "n", "run", "key", F.lit(depth).alias("depth"))
        out = stay if out is None else out.unionByName(stay)
        if last:
            break
        large = open_.where(F.col("size") > small)
        if large.isEmpty():
            break
        split = large.withColumn("child", F.xxhash64("key", F.substring("rest", 8 * (depth - 1) + 1, 8)))
        children = split.groupBy("key", "size", "child").agg(F.count("*").alias("child_size"))
        alike = children.groupBy("key", "size").agg(F.sum(F.col("child_size").cast("double") * F.col("child_size")).alias("kept")).select("key", (F.col("kept") >= 0.5 * F.col("size") * F.col("size")).alias("dense"))
        split = scratch.save(split.join(children.select("key", "child", "child_size").join(alike, "key"), ["key", "child"]), f"split{depth}-{tag}")
        out = out.unionByName(split.where("dense").select("rep", "n", "run", "key", F.lit(depth).alias("depth")))
        open_ = split.where("not dense and child_size > 1").select("rep", "n", "run", F.col("child").alias("key"), "rest", F.col("child_size").alias("size"))
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sets that may be similar by their sizes, and how many members they share: of left and
    right, or i < j within left. Only pairs with 9 |a & b| >= 4 (|a| + |b|), a similarity of 0.8, are returned."""
    every = left + (right or [])
    n = np.array([len(x) for x in every])
    a = len(left)
    none = np.zeros(0, np.int64)
    if len(every) <= 8:
        out = []
        for i in range(a):
            for j in range(i + 1, a) if right is None else range(a, len(every)):
                if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                    common = len(np.intersect1d(every[i], every[j], assume_unique=True))
                    if 9 * common >= 4 * (n[i] + n[j]):
                        out.append((i, j, common))
        found = np.array(out, np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1] - (0 if right is None else a), found[:, 2]
    flat, owner = np.concatenate(every), np.repeat(np.arange(len(every)), n)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    width = -(-max(int(shared.sum()), 1) // 64) * 8
    bits = np.zeros((len(every), width), np.uint8)
    at = place[column[use]]
    np.bitwise_or.at(bits, (owner[use], at >> 3), (1 << (at & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    xs, ys, cs = [none], [none], [none]
    for i in range(a):
        lo, hi = (i + 1, a) if right is None else (a, len(every))
        some = lo + np.flatnonzero(5 * np.minimum(n[lo:hi], n[i]) >= 4 * np.maximum(n[lo:hi], n[i]))
        if not len(some):
            continue
        own = np.flatnonzero(words[i])
        common = np.bitwise_count(words[np.ix_(some, own)] & words[i, own]).sum(axis=1, dtype=np.int64)
        hit = 9 * common >= 4 * (n[some] + n[i])
        xs.append(np.full(int(hit.sum()), i))
        ys.append(some[hit])
        cs.append(common[hit])
    return np.concatenate(xs), np.concatenate(ys) - (0 if right is None else a), np.concatenate(cs)


def roots(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index connected to each."""
    label = np.arange(count)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def grouped(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[list[dict]]:
    """Runs of rows that are equal in some columns."""
    now, rows = None, []
    for batch in rows_at_a_time(batches, 512):
        for r in batch.to_pylist():
            key = tuple(r[c] for c in by)
            if key != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append(r)
    if rows:
        yield rows


def sets_in(members: list[dict]) -> list[np.ndarray]:
    texts = [m["text"].encode() for m in members]
    return shingles(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])), own_names)


def cores(rows: DataFrame) -> DataFrame:
    """rows with `core`: the star if the row is at 0.9 or more to its centre, which is the first row of (star, part)."""
    schema = StructType(rows.drop("centre", "part").schema.fields[:]).add("core", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "star", "part"):
            centre, members = rows[0], [m for m in rows if not m["centre"]]
            for at in range(0, len(members), 256):
                some = members[at : at + 256]
                sets = sets_in([centre, *some])
                own, out = sets[0], {f.name: [m.get(f.name) for m in some] for f in schema}
                common = [len(np.intersect1d(own, x, assume_unique=True)) for x in sets[1:]]
                out["core"] = [m["star"] if 10 * c >= 9 * (len(own) + len(x) - c) else None for m, c, x in zip(some, common, sets[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def brute_force(rows: DataFrame, rounds: int) -> DataFrame:
    """rep, root, links, found, missed from rows (bucket, run, depth, i, j, side, rep, core, copies, keys, text).

    found and missed stand in one row of each task's group: pairs found there, and for each number of rounds up to
    `rounds` how many pairs they stand for that were not.
    """

    def group(members: list[dict]) -> pa.RecordBatch:
        unique: dict[tuple[int, int], dict] = {}
        for m in members:
            unique.setdefault((m["side"], m["rep"]), m)
        members = sorted(unique.values(), key=lambda m: (m["side"], m["rep"]))
        sets = sets_in(members)
        left = sum(m["side"] == 0 for m in members)
        x = y = common = np.zeros(0, np.int64)
        if members[0]["i"] == members[0]["j"]:
            x, y, common = overlaps(sets, None)
        elif 0 < left < len(members):  # pairs within a block are met in (i, i)
            x, y, common = overlaps(sets[:left], sets[left:])
            y = y + left
        rep, copies, core, size = (np.array(v, np.int64) for v in ([m["rep"] for m in members], [m["copies"] for m in members], [-1 if m["core"] is None else m["core"] for m in members], [len(s) for s in sets]))
        keys = np.array([m["keys"] for m in members], np.int64).reshape(len(members), -1)
        first = (core[x] != core[y]) | (core[x] < 0)
        for s in range(members[0]["run"]):
            first &= (keys[x, s] != keys[y, s]) | (keys[x, s] == 0)
        x, y, common = x[first], y[first], common[first]
        links = np.bincount(x, copies[y], len(members)) + np.bincount(y, copies[x], len(members))
        root = rep[roots(len(members), x, y)]
        use = np.zeros(len(members), bool)
        use[x] = use[y] = True
        use = np.flatnonzero(use)
        out_of = 1 - (common / np.maximum(size[x] + size[y] - common, 1)) ** members[0]["depth"]
        missed = [float((out_of ** (ROUND * k) / (1 - out_of ** (ROUND * k))).sum()) for k in range(1, rounds + 1)]
        tail = len(use) - 1
        return pa.record_batch([pa.array(rep[use]), pa.array(root[use]), pa.array(links[use].astype(np.int64)), pa.array([0] * tail + [len(x)] * (tail >= 0), pa.int64()), pa.array([None] * tail + [missed] * (tail >= 0), pa.list_(pa.float64()))], names=["rep", "root", "links", "found", "missed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in grouped(batches, "bucket", "i", "j"):
            yield group(members)

    return rows.mapInArrow(run, "rep long, root long, links long, found long, missed array<double>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """a, root: the least node connected to each node that is not its own root, from edges (a, b)."""
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    before, k = state(e), 0
    while True:  # each round that changes anything brings nodes nearer to their roots
        k += 1
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.save(small, f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        now = state(e)
        if now == before:
            return e.select("a", F.col("b").alias("root"))
        before = now


def buckets_of(reps: DataFrame, scratch: Scratch, runs: range, small: int) -> DataFrame:
    """rep, run, key, depth, size, shingles; of buckets with equal members one."""
    buckets = scratch.save(paths(reps, scratch, runs, small), f"paths-{runs.start}")
    info = buckets.groupBy("run", "key", "depth").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    once = info.groupBy("x", "y", "size", "shingles").agg(F.min(F.struct("run", "key", "depth")).alias("b")).select("b.run", "b.key", "b.depth", "size", "shingles")
    return scratch.save(buckets.select("rep", "run", "key").join(once, ["run", "key"]), f"members-{runs.start}")


def stars_of(member: DataFrame, scratch: Scratch, small: int, block: int) -> DataFrame:
    """rep, star, parts: for members of large buckets the centre of the largest, and in how many parts its star comes."""
    mine = member.where(F.col("size") > small).groupBy("rep").agg(F.max(F.struct("size", "shingles", "run", "key")).alias("b"), F.sum("size").alias("company"))
    mine = scratch.save(mine.select("rep", "b.run", "b.key", "b.size", "b.shingles", "company"), "stars")
    parts = F.greatest(F.ceil(F.max("size") / block), F.ceil(F.max("shingles") / BLOCK_SHINGLES)).cast("int")
    centres = mine.groupBy("run", "key").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("star"), parts.alias("parts"))
    return mine.select("rep", "run", "key").join(centres, ["run", "key"]).select("rep", "star", "parts")


def placed_rows(rows: DataFrame, block: int) -> DataFrame:
    """bucket, run, depth, i, j, side and the member, for each pair of blocks of a bucket that may hold links."""
    each = rows.select("rep", "n", "core", "copies", "keys", "text", F.explode("buckets").alias("b")).select("*", "b.*").drop("b")
    count = rows.select("n", "core", F.explode("buckets").alias("b")).select("n", "core", "b.run", "b.key", "b.size").where("core is not null")
    in_core = count.groupBy("run", "key", "core", "size").agg(F.count("*").alias("c"), F.sum("n").alias("sh"))
    # Buckets that are one core hold no pair to compare; cores of half a block or more get blocks of their own.
    told = in_core.groupBy("run", "key", "size").agg(F.max("c").alias("most"), F.collect_list(F.when(F.col("c") > block // 2, F.struct(F.col("core").alias("g"), "c", "sh"))).alias("cores"))
    told = told.where(F.col("most") == F.col("size")).select("run", "key", F.lit(True).alias("one"), F.lit(None).cast("array<struct<g:bigint,c:bigint,sh:bigint>>").alias("cores")).unionByName(
        told.where((F.col("most") < F.col("size")) & (F.size("cores") > 0)).select("run", "key", F.lit(False).alias("one"), "cores")
    )
    each = each.join(told, ["run", "key"], "left").where("one is null or not one")
    need = lambda c, sh: F.greatest(F.ceil(c / block), F.ceil(sh / BLOCK_SHINGLES), F.lit(1)).cast("int")
    large = (F.col("size") > block) | (F.col("shingles") > BLOCK_SHINGLES)
    held = F.coalesce(F.when(large, F.col("cores")), F.array().cast("array<struct<g:bigint,c:bigint,sh:bigint>>"))
    left_c = F.aggregate(held, F.col("size"), lambda acc, x: acc - x["c"])
    left_sh = F.aggregate(held, F.col("shingles"), lambda acc, x: acc - x["sh"])
    rest = F.filter(F.array(F.struct(F.lit(-1).cast("long").alias("g"), left_c.alias("c"), left_sh.alias("sh"))), lambda x: x["c"] > 0)
    groups = F.concat(rest, held)
    blocks = F.flatten(F.transform(groups, lambda x: F.transform(F.sequence(F.lit(0), need(x["c"], x["sh"]) - 1), lambda p: F.struct(x["g"].alias("g"), p.alias("p")))))
    each = each.withColumn("held", held).withColumn("blocks", F.transform(blocks, lambda x, k: F.struct(x["g"].alias("g"), x["p"].alias("p"), k.alias("k"))))
    own = F.when(F.exists("held", lambda x: x["g"] == F.col("core")), F.col("core")).otherwise(F.lit(-1).cast("long"))
    each = each.withColumn("g", own)
    mates = F.filter("blocks", lambda x: x["g"] == F.col("g"))
    each = each.withColumn("mine", F.get(mates, F.pmod(F.xxhash64("rep"), F.size(mates)).cast("int"))["k"])
    others = F.filter("blocks", lambda x: (x["g"] != F.col("g")) | (F.col("g") < 0))
    each = each.withColumn("other", F.explode(F.transform(others, lambda x: x["k"])))
    return each.select(F.xxhash64("run", "key").alias("bucket"), "run", "depth", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep", "core", "copies", "keys", "text")


def join(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the least id among those it is connected to, or its own),
    n_links (other rows of similarity 0.8 or more, equal ones included), kept (it is the first of its class).

    Null and empty texts have no links. Rows may share an id or have a null one; each is a row of its own.
    """
    spark = docs.sparkSession
    texts = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "rid", scratch).select("rid", "doc_id", "text")
    sets = scratch.save(sets_of(texts), "sets")
    classes = sets.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("copies"), F.min("tokens").alias("tokens"))
    reps = scratch.save(classes.select(F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("rep_doc"), "fp1", "fp2", "n", "copies", "tokens"), "reps")
    shuffle = partitions(docs)
    cored = member = None
    links, spokes = [], []
    found = 0
    missed = [0.0] * (MOST_RUNS // ROUND)
    for k in range(MOST_RUNS // ROUND):
        runs = range(k * ROUND, (k + 1) * ROUND)
        fresh = buckets_of(reps, scratch, runs, small)
        member = fresh if member is None else member.unionByName(fresh)
        keys = F.transform(F.sequence(F.lit(0), F.lit(runs.stop - 1)), lambda r: F.coalesce(F.get(F.filter("every", lambda b: b["run"] == r), F.lit(0))["key"], F.lit(0).cast("long")))
        own = member.groupBy("rep").agg(F.collect_list(F.struct("run", "key", "depth", "size", "shingles")).alias("every")).withColumn("keys", keys)
        own = own.select("rep", "keys", F.filter("every", lambda b: b["run"] >= runs.start).alias("buckets")).where(F.size("buckets") > 0)
        own = own.join(reps.select("rep", "n", "copies"), "rep")
        if k == 0:
            need = own.join(stars_of(fresh, scratch, small, block), "rep", "left")
            rows = scratch.save(texts.select(F.col("rid").alias("rep"), "text").join(need, "rep"), "texts")
            star = rows.where("star is not null")
            part = F.pmod(F.xxhash64("rep"), "parts").cast("int")
            centres = star.where("rep = star").withColumn("centre", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            star = star.withColumn("centre", F.lit(False)).withColumn("part", part).unionByName(centres)
            star = star.repartition(shuffle, "star", "part").sortWithinPartitions("star", "part", F.desc("centre"))
            inside = scratch.save(cores(star), "cores")
            total = inside.where("core is not null").groupBy("core").agg(F.sum("copies").alias("total"))
            cored = inside.where("core is not null").select("rep", "core", "copies")
            links.append(cored.join(total, "core").select("rep", (F.col("total") - F.col("copies")).alias("links")))
            spokes.append(cored.select(F.col("rep").alias("a"), F.col("core").alias("b")))
            columns = ["rep", "n", "core", "copies", "keys", "buckets", "text"]
            rows = rows.where("star is null").withColumn("core", F.lit(None).cast("long")).select(*columns).unionByName(inside.select(*columns))
        else:
            need = own.join(cored.select("rep", "core"), "rep", "left")
            rows = scratch.save(texts.select(F.col("rid").alias("rep"), "text").join(need, "rep"), f"texts{k}")
        met = placed_rows(rows, block).repartition(shuffle, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        new = scratch.save(brute_force(met, MOST_RUNS // ROUND), f"links{k}")
        links.append(new.select("rep", "links"))
        spokes.append(new.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        sums = new.where("found > 0").agg(F.sum("found").alias("n"), *(F.sum(F.get("missed", F.lit(r))).alias(f"m{r}") for r in range(len(missed)))).first()
        found += sums.n or 0
        missed = [m + (sums[f"m{r}"] or 0.0) for r, m in enumerate(missed)]
        if found >= recall * (found + missed[k]):
            break
    every = links[0]
    edges = spokes[0]
    for x, y in zip(links[1:], spokes[1:], strict=True):
        every, edges = every.unionByName(x), edges.unionByName(y)
    linked = components(edges, scratch)
    facts = reps.select("rep", "rep_doc", "fp1", "fp2", "n", "copies").join(every.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(linked.withColumnRenamed("a", "rep"), "rep", "left").where("copies > 1 or links > 0")
    facts = scratch.save(facts.select("fp1", "fp2", "n", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.struct("rep_doc", "rep").alias("me"), F.coalesce("root", "rep").alias("root")), "facts")
    least = facts.groupBy("root").agg(F.min("me").alias("class"))
    facts = scratch.save(facts.join(least, "root").select("fp1", "fp2", "n", "copies", "n_links", "class"), "classes")
    rows = sets.select("rid", "doc_id", "fp1", "fp2", "n")
    # Texts without words have no facts and would all share a key; sets that many rows hold get theirs by broadcast.
    out = join_facts(rows.where("n > 0"), facts, ["fp1", "fp2", "n"], "copies", "left").unionByName(rows.where("n = 0"), allowMissingColumns=True)
    single = F.col("class").isNull()
    return out.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("class.rep_doc")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (single | (F.col("rid") == F.col("class.rep"))).alias("kept"))


def deduplicate(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """docs with the first row of each class only, whatever their other columns."""
    row = clear_name(docs, "row")
    rows = numbered(docs, row, scratch)
    drop = join(rows, scratch, id_col=row, text_col=text_col).where(~F.col("kept")).select(F.col("doc_id").alias(row))
    return rows.join(drop, row, "left_anti").select(*docs.columns)


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
