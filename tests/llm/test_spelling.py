"""Spelling variants against edit distances of all pairs, and against the SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from spangrove.llm import spelling as sp
from spangrove.llm.common import Scratch


def vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=5):
    rest = defaultdict(set)  # words that are alike without one letter: a superset of the near ones
    for w in words:
        rest[w].add(w)
        for i in range(len(w)):
            rest[w[:i] + w[i + 1 :]].add(w)
    pairs = defaultdict(set)
    for group in rest.values():
        for a in group:
            pairs[a] |= {b for b in group if a != b and b not in pairs[a] and near(a, b)}
    forms = {}
    for w, others in pairs.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= times * words[w]:
                forms[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(pairs[w]), words[forms[w]] if w in forms else None))
    return out


def check(spark, words, **limits):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    out = sp.variants(df, Scratch(spark, "t")).collect()
    assert len(out) == len(words)
    assert {tuple(r) for r in out} == brute(words)


def some(seed, n, letters="abé×", long=0):
    rnd = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice([6, 6, 7, 7, 8, 9])))
        words[w] = rnd.choice([5, 6, 30, 31, 160, 5000])
    return words


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    check(spark, some(seed, 700))


def test_runs_of_one_letter(spark):
    """Insertions that many gaps give are one pair."""
    check(spark, {"a" * k: 5 ** (k % 4 + 1) for k in range(6, 60)} | {"a" * k + "b" + "a" * (12 - k): 7 for k in range(13)})


def test_hot_halves_are_dealt_again(spark, monkeypatch):
    """All words share their front, so their buckets are cut down to open stretches that fit."""
    monkeypatch.setattr(sp, "partitions", lambda df: 1000)
    dealt = []
    monkeypatch.setattr(sp, "near_pairs", lambda rows, s, real=sp.near_pairs: dealt.append(rows) or real(rows, s))
    words = {"aaaaaaaaaa" + w: n for w, n in some(9, 900, "abc").items()} | some(10, 300)
    monkeypatch.setattr(sp.buckets, "__defaults__", (4000,))
    check(spark, words)
    assert dealt[0].where("lo > 0 and hi - lo < 5").count() > 900
    sizes = dealt[0].where("hi - lo > 1").groupBy("key").agg({"word": "count"}).toPandas()
    assert sizes["count(word)"].max() * (sp.ROW + 19) <= 4000 * 2


def test_long_words(spark):
    base = "".join(random.Random(5).choice("abcdefgh") for _ in range(20_000))
    words = {base: 100, base[:7000] + "é" + base[7001:]: 5, base[:15_000] + base[15_001:]: 9, base + "z": 700, base[::-1]: 6}
    check(spark, words)


def test_counting(spark, monkeypatch):
    monkeypatch.setattr(sp, "STRETCH", 50)
    monkeypatch.setattr(sp, "HELD", 3000)
    rnd = random.Random(4)
    pool = ["Straße", "straÞe", "ABCDEF", "abcdef", "ÀÉÎÕÜÿ", "pa×÷ck", "ĀbcdefĀ", "x" * 300, "short", "a1bcdefg", "abcdefg", "Ünïcödé", "d́ecomp", "ſeaſons", "Kelvins"]
    rows = [(i, " ,\n-"[i % 4].join(rnd.choice(pool) for _ in range(rnd.randrange(60)))) for i in range(300)]
    rows += [(None, "nothing lost"), (None, None), (5, ""), (6, "lonely " * 50_000), (6, "lonely " * 50_000), (-3, "negative ids too")] * 2
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = {r.word: r.n for r in sp.vocabulary(df).collect()}
    assert got == vocabulary(rows) and len(got) > 10
    assert sp.vocabulary(df.limit(0)).count() == 0
    assert sp.variants(sp.vocabulary(df.limit(0)), Scratch(spark, "t")).count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 100):
        values = rng.permutation(n)
        f, r = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0), np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        q, v = sp.WaveletTree(values).report(f[0], f[1], r[0], r[1])
        got = sorted(zip(q.tolist(), v.tolist()))
        assert got == sorted((i, int(x)) for i in range(50) for x in values[f[0][i] : f[1][i]] if r[0][i] <= x < r[1][i])


def test_query(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{path}/documents.parquet").to_pylist()]
    df = sp.op13_spelling(spark, path)
    out = {tuple(r) for r in df.collect()}
    assert out == brute(vocabulary(rows)) and any(r[1] for r in out)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    got = con.execute(sp.SQL13)
    names = [d[0] for d in got.description]
    assert {tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()} == out
