"""Spelling variants: words within one edit, by two-dimensional range reporting, and the form each word varies.

Words that share all but one place: for an edit at place p, the words that begin as u does up to p are an interval of
the forward order, the words that end as u does behind p an interval of the order of reversed words. A word is a point
(forward rank, reverse rank), and a wavelet tree over the points reports those in both intervals: replacements among
words of u's length, insertions among those that are one longer. Deletions are insertions seen from the other side.

Partitioning: an edit lies either in the front half or in the back half of a word, so words that can be near share the
other half, by which they are dealt to buckets: each word goes to four (two halves, as the shorter and as the longer of a
pair). A bucket that holds more than a fourth of a partition's share is dealt again by the halves of its open half, and
so on; with one open place a bucket holds some thousand words at most. Every pair is found in one bucket: the open places of
the buckets of one word don't overlap, and of the gaps at which an insertion gives the same word the first one counts.

A form has at least `times` the word's count, so chains of forms are as short as a logarithm of the largest count;
roots are followed by a join for each step.

A null text has no words. A null id is written as nothing where ids decide which letters go. Repeated rows count again;
ties of counts go to the first word by code points. Texts are read in stretches of STRETCH characters, cut where no word
is; a word of any length is held whole. Other columns are not read, whatever their names. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, partitions, table, texts_at_a_time

LEAST = 6
#: Maximal runs of LEAST or more letters, A-Z being small already.
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST)
OTHER = re.compile("[^a-zÀ-ÿ]")
STRETCH = 1 << 22
HELD = 32 << 20
#: Bytes of words whose trees one task holds at a time, with ROW for each word; buckets are never cut.
BUCKETS = 16 << 20
ROW = 64
QUERIES = 1 << 20


def stretches(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        gap = OTHER.search(text, at + STRETCH)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = 199) -> DataFrame:
    """word, n: words of all texts, summed over a task's rows. A run whose hash with the id is a multiple of `drop` loses a
    letter (0: none does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in texts_at_a_time(batches, 1):
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for part in stretches(raw.lower().decode("utf-8", "replace")):  # of bytes, lower() changes A-Z only
                    for word, n in Counter(RUN.findall(part)).items():
                        if drop:
                            h = zlib.crc32(word.encode(), start)
                            if h % drop == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < LEAST:
                                    continue
                        if word in counts:
                            counts[word] += n
                        else:
                            counts[word] = n
                            held += len(word) + 100
                    if held > HELD:
                        yield flush()
                        held = 0
        if counts:
            yield flush()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(lambda it: give_back(run(it)), "word string, n long")


def vocabulary(docs: DataFrame, least: int = 5, **columns) -> DataFrame:
    """word, n of the words that occur `least` times over all texts."""
    return counted(docs, **columns).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def with_key(rows: DataFrame) -> DataFrame:
    """rows (word, n, base, role, lo, hi) with the hash of what is fixed: all but the places lo to hi of a word of `base`
    letters (role 0), or of one that is a letter longer (role 1)."""
    front = F.col("word").substr(F.lit(1), F.col("lo"))
    back = F.col("word").substr(F.col("hi") + F.col("role") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("base", "lo", "hi", front, back))


def halves(base: F.Column, role: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    part = lambda a, b: F.struct(base.alias("base"), role.alias("role"), a.alias("lo"), b.alias("hi"))
    return F.filter(F.array(part(lo, middle), part(middle, hi)), lambda x: x["lo"] < x["hi"])


def buckets(words: DataFrame, scratch: Scratch, least: int = BUCKETS) -> DataFrame:
    """word, n, base, role, lo, hi, key: each word in the buckets of its halves, buckets of many words dealt again."""
    size, zero = F.length("word"), F.lit(0)
    first = F.concat(halves(size, zero, zero, size + 1), halves(size - 1, F.lit(1), zero, size))
    rows = scratch.save(with_key(words.select("word", "n", F.explode(first).alias("x")).select("word", "n", "x.*")), "buckets0")
    out, weight, k = None, F.sum(F.length("word") + ROW), 0
    while True:
        total = rows.agg(weight).first()[0] or 0
        tasks = 4 * partitions(rows)
        large = rows.where("hi - lo > 1").groupBy("key").agg(weight.alias("held")).where(F.col("held") > max(least, total / tasks)).select("key")
        large = scratch.save(large, f"large{k}")  # fewer than `tasks` keys, since weights add up to the total
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        fits = rows.join(F.broadcast(large), "key", "left_anti").unionByName(rows.where("hi - lo <= 1").join(F.broadcast(large), "key", "left_semi"))
        out = fits if out is None else out.unionByName(fits)
        again = rows.where("hi - lo > 1").join(F.broadcast(large), "key", "left_semi")
        k += 1
        deal = F.explode(halves(F.col("base"), F.col("role"), F.col("lo"), F.col("hi"))).alias("x")
        rows = scratch.save(with_key(again.select("word", "n", deal).select("word", "n", "x.*")), f"buckets{k}")


class WaveletTree:
    """Of a permutation: which places in an interval hold values in an interval, for many pairs of intervals at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.levels.append(np.append(0, np.cumsum(1 - one)))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, f0: np.ndarray, f1: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, value) for every value in [r0, r1) that stands in [f0, f1)."""
        q, left, right, v = np.arange(len(f0)), f0, f1, np.zeros(len(f0), np.int64)
        for level, zeros in enumerate(self.levels):
            width = 1 << (self.bits - 1 - level)
            l0, r0_ = zeros[left], zeros[right]
            q = np.concatenate([q, q])
            v = np.concatenate([v * 2, v * 2 + 1])
            left, right = np.concatenate([l0, zeros[-1] + left - l0]), np.concatenate([r0_, zeros[-1] + right - r0_])
            keep = (left < right) & (v * width < r1[q]) & ((v + 1) * width > r0[q])
            q, left, right, v = q[keep], left[keep], right[keep], v[keep]
        return q, v


class Order:
    """Words (with their buckets) in order, and the interval of those that share the first letters with each."""

    def __init__(self, bucket: np.ndarray, letters: np.ndarray, longer: np.ndarray):
        n, width = letters.shape
        named = np.empty((n, width + 4), np.uint8)
        named[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(n, 4)
        named[:, 4:] = letters
        self.order = np.argsort(named.view(f"S{width + 4}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        mine, of = letters[self.order], bucket[self.order]
        self.shared = np.full(n, -1, np.int64)  # letters shared with the word before, -1 in another bucket
        if n > 1:
            same = of[1:] == of[:-1]
            self.shared[1:][same] = np.argmax(mine[1:][same] != mine[:-1][same], axis=1)
        self.most = int(self.shared.max(initial=-1))
        self.longer = longer[self.order]
        self.before = [np.append(0, np.cumsum(self.longer == k)) for k in (0, 1)]
        self.place = self.before[0][:-1].copy()  # each word's rank among those of its length
        self.place[self.longer == 1] = self.before[1][:-1][self.longer == 1]

    def intervals(self, length: int, rows: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of rows, the ranks among the (longer) words that share its first `length` letters."""
        cuts = np.flatnonzero(self.shared < length)
        of = np.searchsorted(cuts, self.rank[rows], side="right") - 1
        ends = np.append(cuts[1:], len(self.shared))
        return self.before[longer][cuts[of]], self.before[longer][ends[of]]


def near_in_class(bucket: np.ndarray, words: list[bytes], longer: np.ndarray, base: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): words i of `base` letters and words j that differ by an edit at a place from lo to hi, of the same bucket."""
    n = len(words)
    letters, back = np.zeros((n, base + 1), np.uint8), np.zeros((n, base + 1), np.uint8)
    for k in (0, 1):
        mine = np.flatnonzero(longer == k)
        held = np.frombuffer(b"".join([words[i] for i in mine.tolist()]), np.uint8).reshape(len(mine), base + k)
        letters[mine, : base + k] = held
        back[mine, : base + k] = held[:, ::-1]
    forward, reverse = Order(bucket, letters, longer), Order(bucket, back, longer)
    trees, words_at = [], []
    for k in (0, 1):
        mine = forward.order[forward.longer == k]
        values = reverse.place[reverse.rank[mine]]
        at = np.empty(len(mine), np.int64)  # by rank among the reversed words
        at[values] = mine
        trees.append(WaveletTree(values) if len(mine) else None)
        words_at.append(at)
    short = np.flatnonzero(longer == 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    asked: dict[int, list] = {0: [], 1: []}
    waiting = {0: 0, 1: 0}

    def ask(k: int) -> None:
        if not asked[k]:
            return
        i, p, f0, f1, r0, r1 = (np.concatenate(x) for x in zip(*asked[k], strict=True))
        asked[k], waiting[k] = [], 0
        q, v = trees[k].report(f0, f1, r0, r1)
        i, p, j = i[q], p[q], words_at[k][v]
        # Another word; or the first gap at which this letter gives this word.
        keep = i != j if k == 0 else (p == 0) | (letters[i, np.maximum(p - 1, 0)] != letters[j, p])
        found.append((i[keep], j[keep]))

    for k in (0, 1):
        if trees[k] is None:
            continue
        rest = base - (1 - k)  # letters of the other word that are not at the place
        for p in range(max(lo, rest - reverse.most), min(hi, rest + 1, forward.most + 1)):
            f0, f1 = forward.intervals(p, short, k)
            some = np.flatnonzero(f1 - f0 > 1 - k)
            if not len(some):
                continue
            r0, r1 = reverse.intervals(rest - p, short[some], k)
            both = r1 - r0 > 1 - k
            some = some[both]
            asked[k].append((short[some], np.full(len(some), p), f0[some], f1[some], r0[both], r1[both]))
            waiting[k] += len(some)
            if waiting[k] > QUERIES:
                ask(k)
        ask(k)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_pairs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """word, near, near_n: both directions of each pair of words that one edit tells apart, once."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, word, n, base, role, lo, hi = held
        key, base, role, lo, hi, n = (np.array(x, np.int64) for x in (key, base, role, lo, hi, n))
        kind, of = np.unique(np.stack([base, lo, hi]), axis=1, return_inverse=True)
        of = of.ravel()
        order = np.argsort(of, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            _, bucket = np.unique(key[mine], return_inverse=True)
            short = np.bincount(bucket, weights=role[mine] == 0)
            live = ((short > 1) | (short > 0) & (np.bincount(bucket) > short))[bucket]
            mine, bucket = mine[live], bucket[live]
            if not len(mine):
                continue
            b, first, last = kind[:, of[mine[0]]].tolist()
            i, j = near_in_class(bucket, [word[x].encode("latin-1") for x in mine.tolist()], role[mine], b, first, last)
            i, j = mine[i], mine[j]
            back = role[j] == 1  # a replacement is found from both sides
            a, z = np.concatenate([i, j[back]]), np.concatenate([j, i[back]])
            for s in range(0, len(a), 1 << 16):
                x, y = a[s : s + (1 << 16)], z[s : s + (1 << 16)]
                yield pa.record_batch([pa.array([word[t] for t in x.tolist()], pa.string()), pa.array([word[t] for t in y.tolist()], pa.string()), pa.array(n[y])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(7)]
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BUCKETS and row[0] != last:
                    yield from solve(held)
                    held, size = [[] for _ in range(7)], 0
                last = row[0]
                size += len(row[1]) + ROW
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        if held[0]:
            yield from solve(held)

    dealt = rows.select("key", "word", "n", "base", "role", "lo", "hi").repartition(partitions(rows), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: give_back(run(it)), "word string, near string, near_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of the words that have a form: forms (word, form) followed to the last, a join for each step."""
    steps = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    active, out, k = forms.select("word", F.col("form").alias("root")), None, 0
    while True:
        moved = scratch.save(active.join(steps, "root", "left"), f"roots{k}")
        done = moved.where("next is null").select("word", "root")
        out = done if out is None else out.unionByName(done)
        active = moved.where("next is not null").select("word", F.col("next").alias("root"))
        if active.isEmpty():
            return out
        k += 1


def variants(words: DataFrame, scratch: Scratch, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n. words: word, n, each word once."""
    words = scratch.save(words, "words")
    pairs = near_pairs(buckets(words, scratch), scratch)
    near = pairs.select("word", F.lit(None).cast("long").alias("n"), "near", "near_n").unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), "near")))
    each = near.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    each = scratch.save(each.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")), "each")
    found = each.where("form is not null")
    return each.join(roots(found, scratch), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of six letters and five occurrences, the forms they vary and the roots of these."""
    scratch = Scratch(spark, "op13")
    return variants(vocabulary(table(spark, sf_dir, "documents")), scratch)


SQL13 = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) x(i)),
  run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
  once AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 6 GROUP BY ALL),
  coded AS (SELECT *, list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END))) AS b FROM once),
  hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM coded, tab),
  cut AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(w, h % length(w)), substring(w, h % length(w) + 2)) ELSE w END AS word, n FROM hashed),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  less AS (SELECT word, n, i, concat(left(word, i - 1), substring(word, i + 1)) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
  pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pairs GROUP BY word),
  forms AS (SELECT best.word, min(near) AS form, any_value(m) AS form_n FROM best JOIN pairs ON pairs.word = best.word AND near_n = m JOIN words ON words.word = best.word WHERE m >= 5 * words.n GROUP BY best.word),
  chain AS (SELECT word, form AS root, 1 AS step FROM forms UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root)
SELECT words.word, form, coalesce(r.root, words.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r USING (word)
"""
