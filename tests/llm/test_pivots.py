"""Pivot search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spangrove.llm import pivot_search as ps
from spangrove.llm.common import Scratch


def brute(rows, every, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 12))
    rows = [(i, [float(np.float32(x)) for x in (centre[i % 5] + rng.normal(size=12) * 0.1).round(seed)]) for i in range(400)]
    rows += [(400, None), (405, [1.0] * 11 + [None]), (410, [float("nan")] * 12), (415, [float("inf")] * 12), (7, rows[7][1]), (50, rows[50][1]), (420, [1.0, 2.0]), (421, [3.0, 1.0]), (425, [0.0] * 12)]
    monkeypatch.setattr(ps, "BLOCK", 16)
    monkeypatch.setattr(ps, "PACK", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("Block", F.lit("x")).repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ps.search(df, Scratch(spark, "t"), F.col("vec_id") % 5 == 0).collect())
    assert got == brute(rows, 5, 5)


def test_elimination_skips_candidates():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-3, 3, (500, 8)) + c for c in (0, 400, -400)])
    d = ps.distances(v, v[::100])
    best = ps.Best(np.arange(5), np.arange(5), v[500:505], d[500:505], 3)
    best.rids = np.arange(500, 505)
    best.take(np.arange(1500), np.arange(1500), v, d)
    assert best.evaluated < 5 * 1499
    for i, top in zip(range(500, 505), best.top, strict=True):
        s = [(-int(v[i] @ v[j]), j) for j in range(1500) if j != i]
        assert [x[:2] for x in top] == sorted(s)[:3]


def test_blocks_are_left_out_before_they_are_sent(spark, monkeypatch):
    monkeypatch.setattr(ps, "BLOCK", 32)
    monkeypatch.setattr(ps, "PACK", 8)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16)) * 40
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=16) * 0.01]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    scratch = Scratch(spark, "t")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ps.search(df, scratch, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, 50, 5)
    blocks = spark.read.parquet(f"{scratch.root}/blocks").groupBy("kind").count().collect()
    count = {r.kind: r["count"] for r in blocks}
    assert spark.read.parquet(f"{scratch.root}/pairs").count() < 0.6 * count["b"] * count["q"]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ps.search(df, Scratch(spark, "t"), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert ps.search(df.limit(0), Scratch(spark, "t"), F.col("vec_id") == 0).count() == 0


def test_large_components():
    q, v = np.array([2**30, 2**29]), np.array([[2**31, 7], [1, -(2**31)]])
    assert ps.products(q, v).tolist() == [2**61 + 7 * 2**29, 2**30 - 2**60]


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ps.op8_pivot_search(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ps.SQL8})").fetchall()) == got


def test_components_beyond_64_bits_are_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from spangrove.llm import pivot_search as ps
    from spangrove.llm.common import Scratch

    held = spark.createDataFrame([(0, [2.0**54, 1.0]), (1, [-(2.0**54), 2.0])], "vec_id long, v array<double>")
    assert [r.v for r in ps.quantised(held, "vec_id", "v", F.lit(True)).orderBy("id").collect()] == [[2**62, 256], [-(2**62), 512]]
    with pytest.raises(Exception, match="64 bits"):
        ps.quantised(held.unionByName(spark.createDataFrame([(2, [1e17, 2e17])], "vec_id long, v array<double>")), "vec_id", "v", F.lit(True)).collect()
