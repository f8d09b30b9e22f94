"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spangrove.llm import chosen_path as cp
from spangrove.llm.common import Scratch, arrow_bytes


def plain_set(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [plain_set(t) for _, t in docs]
    links = [[] for _ in docs]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].append(j)
    label = list(range(len(docs)))
    for _ in docs:
        for i, x in enumerate(links):
            for j in x:
                label[i] = label[j] = min(label[i], label[j])
    return links, label


def corpus(seed, groups, size):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    return docs


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("words", range(7))
def test_batches_of_few_words(words):
    """Slices of every small number of words, alone and between rows without any."""
    text = " ".join("abcdefg"[:words])
    for rows in ([text], ["", text, " "], text.split(), [text, "a b"], [None, text, None]):
        buf, offsets = arrow_bytes(pa.array(rows, pa.string()))
        for names in (cp.keyed_hash, cp.own_names):
            assert [len(x) for x in cp.shingles(buf, offsets, names)] == [len(plain_set(t)) for t in rows]


def test_words_that_sums_cannot_tell_apart(spark):
    rest = " c d e f g h i j k l"
    docs = [(i, f"{thue_morse(n, flip)} x y z" + rest) for i, (n, flip) in enumerate((n, f) for n in (1024, 2048, 4096) for f in (False, True))]
    docs += [(10, "a b"), (11, "a b c"), (12, None), (13, "a"), (14, "a b")]
    got = {r.doc_id: r.n_links for r in cp.join(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), Scratch(spark, "t")).collect()}
    links, _ = brute(docs)
    assert got == {i: len(x) for (i, _), x in zip(docs, links, strict=True)}


@pytest.mark.parametrize("small,block,recall", [(256, 1024, 0.995), (3, 5, 1.0)])
def test_against_brute_force(spark, small, block, recall):
    texts = corpus(3, 25, 9) + corpus(4, 2, 40) + [None, "", " \n", "one two", "ONE\ttwo", "one two three four five", "alone"]
    docs = list(enumerate(texts)) + [(5, texts[5]), (5, texts[40]), (None, texts[9])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, Rid long").repartition(4)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_links), r.class_id) for r in cp.join(df, Scratch(spark, "t"), small=small, block=block, recall=recall).collect())
    links, _ = brute(docs)
    assert [g[0] for g in got] == sorted((i is not None, i or 0, len(x)) for (i, _), x in zip(docs, links, strict=True))


def test_classes(spark):
    texts = corpus(7, 30, 6)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, label = brute(docs)
    got = {r.doc_id: r for r in cp.join(df, Scratch(spark, "t")).collect()}
    assert [got[i].class_id for i in range(len(docs))] == label
    assert [got[i].kept for i in range(len(docs))] == [i == x for i, x in enumerate(label)]
    kept = cp.deduplicate(df, Scratch(spark, "t"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_overlaps_equal_sets():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(80) < rng.choice([0.03, 0.3]), rng.integers(0, 1 << 60, 80, dtype=np.uint64), base)) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    x, y, common = cp.overlaps(sets, None)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
    assert all(len(set(sets[i]) & set(sets[j])) == c for i, j, c in zip(x, y, common, strict=True))
    x, y, _ = cp.overlaps(sets[:25], sets[25:])
    assert set(zip(x.tolist(), (y + 25).tolist(), strict=True)) == {(i, j) for i, j in want if i < 25 <= j}


def test_shingles_equal_word_tuples():
    texts = ["a b c d e f", "A  b\nc d e f", "a b", "", "a b c d e a b c d e a b c d e"]
    buf, offsets = arrow_bytes(pa.array(texts))
    got = cp.shingles(buf, offsets)
    assert [len(x) for x in got] == [len(plain_set(t)) for t in texts] and np.array_equal(got[0], got[1])


def test_cores_need_no_comparison(spark, monkeypatch):
    """One large group of near copies: only what is not in its core is compared."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for i in range(150):
        w = list(base)
        for _ in range(1 if i % 10 else 6):
            w[rng.randrange(len(w))] = f"n{i}"
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    got = {r.doc_id: (r.n_links, r.class_id) for r in cp.join(df, scratch, small=16, block=32).collect()}
    links, label = brute(docs)
    assert got == {i: (len(links[i]), label[i]) for i, _ in docs}
    met = spark.read.parquet(f"{scratch.root}/links0").agg({"found": "sum"}).first()[0]
    assert 0 < met < sum(map(len, links)) / 4


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.a: r.root for r in cp.components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def test_empty(spark):
    assert cp.join(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0
    assert [r.n_links for r in cp.join(spark.createDataFrame([(1, None)], "doc_id long, text string"), Scratch(spark, "t")).collect()] == [0]
