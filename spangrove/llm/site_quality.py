"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model of surface statistics and of hashed words, fitted on at most `max_labels` labelled documents (those
with the smallest hashes of their ids), gives each document's own evidence: its log odds less those of the labelled mean.
Labels where there are any, and the model's probabilities elsewhere, are summed for every path of every host, for every
host and over the corpus. A host's rate is shrunk toward the corpus's, a path's toward its host's, each by a prior
strength estimated by the method of moments, so a site with few documents says what its parent says. The rates that a
document meets leave out its own evidence, which would count twice otherwise: the only document of a site meets what the
rest of the corpus says. A document is kept if its evidence and its path's posterior together give a probability of at
least `threshold`; every document has its row, those that are not kept too.

Where documents have a URL, with_site splits it into host and path; those of op1 have none, so `source` is the host and
`lang` the path; other columns can be named. A null host or path is one of its own (the empty string). A null text is
empty. Documents without words are rejected, as is every document if no label of 1 is there; with no labels at all every
document with words is kept at probability 0.5. Repeated documents are judged alike; of repeated labels the mean counts;
of documents that share a labelled id one is learned from. A kept document is one of at least `threshold`, ties
included. Other columns are not read. Texts are taken whole, in slices of SLICE_BYTES or one text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Scratch, arrow_bytes, clear_name, distinct_spans, join_facts, numbered, table, texts_at_a_time, word_spans

MAX_LABELS = 20_000
SURFACE = ["upper", "digits", "shouts", "bars", "signs", "stops", "lines", "word_length", "distinct", "repeats", "same_lines", "log_words", "short_words"]
BUCKETS = 64
FEATURES = SURFACE + [f"words{i}" for i in range(BUCKETS)]
SLICE_BYTES = 2 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT, _SHOUT, _BAR, _SIGN, _STOP, _LINE = _class(b"0123456789"), _class(b"!"), _class(b"|\t"), _class(b"#$%&*+/<=>@[\\]^_`{}~"), _class(b".,;:?"), _class(b"\n")


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask[buf]))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    s, e = word_spans(buf, offsets)
    names, keys = distinct_spans(LOWER[buf], s, e)
    row = np.searchsorted(offsets, s, side="right") - 1
    words = np.bincount(row, minlength=n).astype(float)
    many = np.maximum(words, 1)
    again = np.zeros(len(keys))
    again[1:] = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
    bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in names), np.int64, len(names))
    held = np.bincount(row * BUCKETS + bucket[keys], minlength=n * BUCKETS).reshape(n, BUCKETS) if len(keys) else np.zeros((n, BUCKETS))
    ls = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(buf)], np.flatnonzero(buf == 10) + 1]))
    ls = ls[ls < len(buf)]
    le = np.append(ls[1:], len(buf))
    line_row = np.searchsorted(offsets, ls, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    letters = np.maximum(share(_LETTER), 1)
    solid = size - share(SPACE)
    surface = np.stack(
        [
            share(_UPPER) / letters, share(_DIGIT) / size, share(_SHOUT) / size, share(_BAR) / size, share(_SIGN) / size, share(_STOP) / size, share(_LINE) / many, np.minimum(solid / many, 30),
            _distinct(row, keys, n) / many, np.bincount(row, again, n) / many, 1 - _distinct(line_row, distinct_spans(buf, ls, le)[1], n) / np.maximum(lines, 1), np.log1p(words), np.bincount(row, e - s <= 3, n) / many,
        ],
        axis=1,
    )
    return np.hstack([surface, held / many[:, None]])


def _distinct(row: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each row has."""
    pairs = np.unique(row * (int(keys.max()) + 1 if len(keys) else 1) + keys)
    return np.bincount(pairs // (int(keys.max()) + 1 if len(keys) else 1), minlength=n)


def with_site(df: DataFrame, url_col: str, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """df with the host of a URL, without `www.`, and the first part of its path; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return df.withColumn(host_col, host).withColumn(path_col, path)


class Logistic:
    """A ridge logistic model of standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 25):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(z.shape[1])
            self.w += np.linalg.solve(h, z.T @ (y - p) - self.w)
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-1 - z, 0), np.ones((len(z), 1))])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def strength(groups: DataFrame, n: str, good: str, parent: str) -> float:
    """Prior strength of the groups' rates about their parents' (column `parent`), by the method of moments."""
    rate = F.col(good) / F.col(n)
    spread = F.pow(rate - F.col(parent), 2) - F.col(parent) * (1 - F.col(parent)) / F.col(n)
    row = groups.agg((F.sum(F.col(n) * spread) / F.sum(n)).alias("between"), F.avg(F.col(parent) * (1 - F.col(parent))).alias("within")).first()
    if row is None or row.between is None or row.between <= 0:
        return 1e6 if row is not None and row.within else 1.0
    return float(min(max(row.within / row.between - 1, 1.0), 1e6))


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.5, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", row_col: str | None = None) -> DataFrame:
    """doc_id, host, path, doc_prob, host_posterior, path_posterior, quality and keep for every row of docs, and the
    column row_col of docs as `row` if it is named."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text(host_col).alias("host"), text(path_col).alias("path"), row, text(text_col).alias("text"))
    known = scratch.save(labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label_col).cast("double").alias("y")), "known")
    model = fitted(rows, known, max_labels)
    words = FEATURES.index("log_words")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_at_a_time(batches, 4, SLICE_BYTES):
            x = features(*arrow_bytes(batch.column(4)))
            odds = model.log_odds(x) if model else np.zeros(len(x))
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(odds), pa.array(x[:, words] > 0)], names=["doc_id", "host", "path", "row", "odds", "words"])

    scored = scratch.save(rows.mapInArrow(score, "doc_id long, host string, path string, row long, odds double, words boolean"), "scored")
    out = ["doc_id", "host", "path", *["row"] * bool(row_col)]
    if not model:
        half = [F.lit(0.5).alias(c) for c in ("doc_prob", "host_posterior", "path_posterior", "quality")]
        return scored.select(*out, *half, F.col("words").alias("keep"))
    # Rows without an id have no label; apart, they do not all meet in one task.
    soft = F.coalesce("y", 1 / (1 + F.exp(-F.col("odds"))))
    told = scored.where("doc_id is not null").join(known, "doc_id", "left").unionByName(scored.where("doc_id is null").withColumn("y", F.lit(None).cast("double")))
    scored = scratch.save(told.select(*scored.columns, soft.alias("own")), "weighed")
    paths = scratch.save(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("own").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = total.good / total.n if total.n else 0.5
    shrunk = lambda good, n, m, parent: (good + m * parent) / (n + m)
    m = strength(hosts.withColumn("parent", F.lit(rate)), "host_n", "host_good", "parent")
    hosts = hosts.withColumn("parent", shrunk(F.col("host_good"), F.col("host_n"), m, F.lit(rate)))
    sites = scratch.save(paths.join(hosts, "host"), "sites")
    m2 = strength(sites, "n", "good", "parent")
    met = join_facts(scored, sites.drop("parent").withColumn("rows", F.col("n")), ["host", "path"], "rows")
    others = (F.lit(total.good) - F.col("own")) / (total.n - 1) if total.n and total.n > 1 else F.lit(0.5)
    met = met.withColumn("host_posterior", shrunk(F.col("host_good") - F.col("own"), F.col("host_n") - 1, m, others))
    met = met.withColumn("path_posterior", shrunk(F.col("good") - F.col("own"), F.col("n") - 1, m2, F.col("host_posterior")))
    inside = F.least(F.greatest("path_posterior", F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = F.col("odds") - model.base + F.log(inside / (1 - inside))
    quality = 1 / (1 + F.exp(-odds))
    return met.select(*out, (1 / (1 + F.exp(-F.col("odds")))).alias("doc_prob"), "host_posterior", "path_posterior", quality.alias("quality"), (F.col("words") & (quality >= threshold)).alias("keep"))


def fitted(rows: DataFrame, known: DataFrame, max_labels: int) -> Logistic | None:
    """The model of a bounded sample of the labelled rows; None without any."""
    count = known.count()
    if not count or max_labels <= 0:
        return None
    # A threshold on the hash first, so that few more than max_labels leave the tasks.
    order = F.xxhash64("doc_id")
    share = min(1.0, 1.2 * max_labels / count + 1000 / count)
    chosen = known.where(order <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1))).orderBy(order, "doc_id").limit(max_labels)
    # At most max_labels rows of two numbers.
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_at_a_time(batches, 1, SLICE_BYTES):
            x = features(*arrow_bytes(batch.column(1))).astype(np.float32)
            yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["y", "x"])

    sample = texts.select("y", "text").mapInArrow(run, "y double, x array<float>").toArrow()
    if not sample.num_rows:
        return None
    x = np.asarray(sample["x"].combine_chunks().flatten(), dtype=float).reshape(-1, len(FEATURES))
    return Logistic(x, np.asarray(sample["y"]))


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without those that are rejected, whatever their other columns. Rows that share an id are judged one by one."""
    row = clear_name(docs, "row")
    rows = numbered(docs, row, scratch)
    bad = judge(rows, labels, scratch, row_col=row).where(~F.col("keep")).select(F.col("row").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what speaks for it, and whether it is kept."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op1"))
