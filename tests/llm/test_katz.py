"""Katz backoff against a plain model in dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spangrove.llm import katz
from spangrove.llm.common import Scratch


def tokens(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


class Plain:
    def __init__(self, docs):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for i, t in docs:
            if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
                prev = "<s>"
                for w in tokens(t):
                    self.uni[w] += 1
                    self.bi[prev, 1][w] += 1
                    prev = w
        self.n = sum(self.uni.values())
        self.d1 = self.discounts(Counter(self.uni.values()))
        self.d2 = self.discounts(Counter(c for x in self.bi.values() for c in x.values()))

    @staticmethod
    def discounts(n):
        out = {}
        top = 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
            d = (good - top) / (1 - top) if top != 1 else 0.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def level(self, counts, d):
        total = sum(counts.values())
        p = {w: d.get(c, 1.0) * c / total for w, c in counts.items()}
        left = sum((1 - d.get(c, 1.0)) * c for c in counts.values()) / total if total else 1.0
        if total and left <= 0:
            p, left = {w: c / (total + 1) for w, c in counts.items()}, 1 / (total + 1)
        return p, left

    def p(self, h, w):
        uni, unseen = self.level(self.uni, self.d1)
        if (h, 1) not in self.bi:
            return uni.get(w, unseen)
        p, left = self.level(self.bi[h, 1], self.d2)
        if w in p:
            return p[w]
        return left / (1 - sum(uni[x] for x in p)) * uni.get(w, unseen)


@pytest.mark.parametrize("hot,block", [(1 << 18, 1_200_000), (3, 50), (20, 50)])
def test_against_plain_model(spark, hot, block):
    rng = np.random.default_rng(0)
    words = ["The", "the", "of", "AND", "é", "x1", "run", "a,b", "z"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30), p=(p := 1 / np.arange(1, len(words) + 1)) / p.sum()))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "unheard words only\tthe\vend"), (3, docs[3][1]), (None, "the of")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(4)
    model = Plain(docs)
    got = katz.score(df, Scratch(spark, "t"), hot=hot, block_tokens=block).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t in docs:
        prev, score, base = "<s>", 0.0, 0.0
        for w in tokens(t):
            score += math.log10(model.p(prev, w))
            base += math.log10((model.uni[w] + 1) / (model.n + len(model.uni) + 1))
            prev = w
        want[i] = (len(tokens(t)), sum(model.uni[w] > 0 for w in tokens(t)), base, score)
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, model.n)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and abs(r.score - score) < 1e-9 * max(1, abs(score)), r
    for h in ["<s>", "the", "of", None, "never"]:
        vocabulary = [*model.uni, "an unseen word"]
        assert abs(sum(model.p(h, w) for w in vocabulary) - 1) < 1e-9


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("hot", [1 << 18, 4])
def test_tables_of_counts(spark, hot):
    """The tables that the model leaves hold exactly the training counts."""
    words = [thue_morse(1024), thue_morse(1024, True), "of", "the", "é"]
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(words, 8))) for i in range(60)]
    scratch = Scratch(spark, "t")
    katz.score(spark.createDataFrame(docs, "doc_id long, text string"), scratch, order=3, hot=hot, block_tokens=100).count()
    uni, tri = Counter(), Counter()
    for i, t in docs:
        if not katz.is_held_out(i):
            x = ["<s>", "<s>", *(w or "" for w in tokens(t))]
            uni.update(x[2:])
            tri.update(zip(x, x[1:], x[2:]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = katz.model(spark, scratch, 1).collect()
    assert {r.word: r["count"] for r in rows} == uni
    name = {r["rank"] * n + r.bucket: r.word for r in rows}
    assert {tuple(name.get(w, "<s>") for w in r.words): r["count"] for r in katz.model(spark, scratch, 3).collect()} == tri


def test_squeeze():
    for a in (np.arange(7, dtype=np.uint64), np.zeros(0, np.int64), np.array([1.5, -2]), np.array([3], np.uint16)):
        b = katz.expand(katz.squeeze(a))
        assert np.array_equal(a, b) and (b.dtype == a.dtype or a.dtype.kind == "u")
    words = [b"", b"a", "é".encode(), b"", b"long" * 50]
    assert katz.expand_words(katz.squeeze_words(pa.array(words)[1:])).to_pylist() == words[1:]
    assert katz.expand_words(katz.squeeze_words(pa.array([b""]))).to_pylist() == [b""]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(df, Scratch(spark, "t")).count() == 0
    one = spark.createDataFrame([(2, "a b"), (9, None)], "doc_id long, text string")
    assert katz.score(one, Scratch(spark, "t")).count() == 2


def test_distinct():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.int64), np.array([7]), rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 1000).repeat(2), rng.integers(0, 1 << 63, 99, dtype=np.uint64) * np.uint64(2), np.array([3, 1, 3], np.uint64)):
        some, first, back = katz.distinct(keys)
        want = np.unique(keys, return_index=True, return_inverse=True)
        assert some.dtype == keys.dtype and all(np.array_equal(a, b) for a, b in zip((some, first, back), want, strict=True))
        assert np.array_equal(katz.expand_rising(katz.rising(some.astype(np.uint64))), some)


def test_requests_travel_in_batches(spark):
    """Before, a batch for each of a block's requests, and there are as many of these as buckets."""
    words = 400
    tokens = np.random.default_rng(2).integers(0, words, 5000).astype(np.uint32)
    row = {"block": 5, "tokens": katz.squeeze(tokens), "gid": katz.squeeze(np.ones(words, np.uint64)), "count": katz.squeeze(np.full(words, 9, np.uint64)), "docs": [1, 2], "lens": [3000, 2000]}
    known = pa.RecordBatch.from_pylist([row], schema=katz.arrow_schema(katz.KNOWN))
    batches = list(katz.ask_cold(3, 300, 1 << 19, (9, words + 1))(iter([known])))
    assert sum(b.num_rows for b in batches) > 200 and len(batches) <= 6


def test_grams_of_a_bucket_are_squeezed(spark):
    """Before, each bucket's n-grams went through the JVM as lists of longs, value by value."""
    kinds = {f.name: f.type for f in katz.arrow_schema(katz.COLD)}
    assert all(kinds[n] == pa.binary() for n in ("w", "c", "last", "last_count")) and kinds["h"].value_type == pa.binary()
