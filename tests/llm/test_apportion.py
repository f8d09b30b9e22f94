"""Mixing: targets, quotas and what is taken, against plain loops."""

import heapq
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spangrove.llm import apportion as ap
from spangrove.llm.common import Scratch


def filled(sizes, weights=(1, 2, 3), most=3):
    """source -> target, exactly. sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), set()
    while True:
        rest, open_ = total - most * sum(sizes[s] for s in fixed), sum(w[s] for s in order if s not in fixed)
        above = {s for s in order if s not in fixed and Fraction(rest * w[s], open_) > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in fixed else Fraction(rest * w[s], open_ or 1) for s in order}
        fixed |= above


def greedy(votes, seats):
    """Seat after seat to the highest quotient; ties to the least name."""
    heap = [(-Fraction(v), p, 0) for p, v in votes.items() if v > 0]
    heapq.heapify(heap)
    out = Counter()
    for _ in range(seats if heap else 0):
        _, p, k = heapq.heappop(heap)
        out[p] += 1
        heapq.heappush(heap, (-Fraction(votes[p]) / (2 * k + 3), p, k + 1))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    groups = {g: ({p: rnd.choice([0, 1, 1, 2, 5, 40, 41, rnd.randrange(3000)]) * (1000 if p == 3 else 1) for p in range(rnd.choice([1, 2, 3, 30]))}, rnd.choice([0, 1, 5, 37, 1000])) for g in range(12)}
    rows = [(g, p, v, n) for g, (votes, n) in groups.items() for p, v in votes.items()]
    got = ap.highest_quotients(spark.createDataFrame(rows, "g long, p long, v long, n long"), ["g"], "p", "v", "n").collect()
    assert len(got) == len(rows)
    for g, (votes, n) in groups.items():
        want = greedy(votes, n)
        assert {r.p: r.quota for r in got if r.g == g} == {p: want[p] for p in votes}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size int, shard int")


def corpus(seed, n=400):
    rnd = random.Random(seed)
    pick = lambda: "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "é", "Z", None, "", "tiny" if rnd.random() < 0.1 else "c"])
    rows = [(i, " ".join(["w\x0b"] * rnd.choice([0, 1, 3, 50, 700])), pick()) for i in range(n)]
    rows += [(None, "null id text", "a"), (None, "null id text", "a"), (7, None, "b"), (8, " \t\n", "blank"), (1000, "x " * 100_000, "b")]
    return rows + [(2000, "copied copied", "hot")] * 9000


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(ap, "SHARD", 5000)
    rows = corpus(1)
    df = frame(spark, rows)
    out = ap.mix(df, Scratch(spark, "t"), block=64).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = filled(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
    assert sum(want.values()) == sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 2 * 64), s
    # quotas of sources by plain highest quotients
    blocks = greedy({ap_key(s): t for s, t in want.items()}, (2 * sum(sizes.values()) + 64) // 128)
    # the ring, word by word, in the order of the seeded hashes
    h = df.select("doc_id", "source", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(17)).alias("t")).withColumn("order", F.xxhash64("doc_id", "t", F.lit(17))).withColumn("h", F.xxhash64("order", F.lit(17))).collect()
    held = Counter()
    for s in sizes:
        held[s] = len({(i, x) for i, x, y in rows if y == s})
    rings = defaultdict(list)
    for r in h:
        shards = -(-(sizes[r.source] + held[r.source]) // 5000)
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        rings[r.source, r.h % shards].append((r.order, -1 if r.doc_id is None else r.doc_id, size))
    per = defaultdict(dict)
    for (s, k), docs in rings.items():
        per[s][k] = sum(x[2] for x in docs)
    begin = {(r.key, r.shard): r.b for r in spark.createDataFrame([(ap_key(s), k) for s, k in rings], "key string, shard long").select("key", "shard", F.xxhash64("key", "shard", F.lit(17)).alias("b")).collect()}
    expected = Counter()
    for s, words in per.items():
        quota = greedy(words, blocks[ap_key(s)])
        for k, n in words.items():
            times = [0] * n
            at = begin[ap_key(s), k] % n if n else 0
            for j in range(min(quota[k] * 64, 3 * n)):
                times[(at + j) % n] += 1
            i = 0
            for _, doc, size in sorted(rings[s, k]):
                expected[doc, s, size, sum(times[i : i + size])] += 1
                i += size
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.source, r.size, r.taken) for r in out) == expected


def ap_key(s):
    return "\U0010ffff" if s is None else "=" + s


def test_reruns_agree(spark):
    rows = [r for r in corpus(2, 200)[:-8990] if r[0] != 1000]
    a = ap.mix(frame(spark, rows), Scratch(spark, "t"))
    b = ap.mix(frame(spark, rows[::-1]).repartition(5, "text"), Scratch(spark, "t"))
    assert Counter(a.collect()) == Counter(b.collect())
    assert Counter(ap.mix(frame(spark, rows), Scratch(spark, "t"), seed=3).collect()) != Counter(a.collect())


def test_empty_and_wordless(spark):
    assert ap.mix(frame(spark, [(1, "a", "s")]).limit(0), Scratch(spark, "t")).count() == 0
    out = ap.mix(frame(spark, [(1, None, "s"), (2, "  ", None), (2, "  ", None)]), Scratch(spark, "t")).collect()
    assert len(out) == 3 and {(r.size, r.target, r.taken) for r in out} == {(0, 0.0, 0)}
    assert [(r.size, r.target, r.taken) for r in ap.mix(frame(spark, [(1, "one", "s")]), Scratch(spark, "t")).collect()] == [(1, 1.0, 1)]


def test_all_capped_but_one(spark):
    rows = [(i, "w " * 10, f"s{i:02}") for i in range(30)] + [(99, "w " * 2000, "zz")]
    out = {r.source: r for r in ap.mix(frame(spark, rows), Scratch(spark, "t")).collect()}
    want = filled({f"s{i:02}": 10 for i in range(30)} | {"zz": 2000})
    assert all(abs(out[s].target - t) < 1e-6 and abs(out[s].taken - t) <= 1 for s, t in want.items())


def test_query(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    out = {r.doc_id: r for r in ap.op12_sainte_lague(spark, "/root/testdata/sf0.01").collect()}
    sizes, source, taken = Counter(), {}, Counter()
    for d in docs:
        source[d["doc_id"]] = d["source"]
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        taken[d["source"]] += out[d["doc_id"]].taken
    want = filled(sizes)
    assert len(out) == len(docs)
    for i, s in source.items():
        assert out[i].source_size == sizes[s] and abs(out[i].target - want[s]) < 1e-6 * want[s]
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)
