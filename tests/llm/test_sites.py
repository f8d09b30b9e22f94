"""Quality with hierarchical shrinkage."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from spangrove.llm import site_quality as sq
from spangrove.llm.common import Scratch, arrow_bytes


def test_features_of_odd_texts():
    buf, offsets = arrow_bytes(pa.array(["", None, "A b b b", "x\nx\nx\n", "!!! A|B", "é"]))
    x = sq.features(buf, offsets)
    assert x.shape == (6, len(sq.FEATURES)) and np.isfinite(x).all()
    assert x[2][sq.FEATURES.index("repeats")] == 0.5 and abs(x[3][sq.FEATURES.index("same_lines")] - 2 / 3) < 1e-9


def test_strength_and_shrinkage(spark):
    rows = [(f"h{h}", "p", float(n), float(g)) for h, (n, g) in enumerate([(1000, 900), (1000, 100), (1000, 500), (2, 0)])]
    groups = spark.createDataFrame(rows, "host string, path string, n double, good double")
    from pyspark.sql import functions as F

    m = sq.strength(groups.withColumn("parent", F.lit(0.5)), "n", "good", "parent")
    assert 1 <= m < 10  # hosts differ much, so little is borrowed


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = {r.doc_id: r.keep for r in sq.judge(docs, train, Scratch(spark, "t")).collect()}
    truth = {r.doc_id: r.quality for r in test.collect()}
    good = [got[d] for d, q in truth.items() if q]
    bad = [got[d] for d, q in truth.items() if not q]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_posteriors_equal_plain_python(spark):
    """Rates, prior strengths, posteriors and decisions, from each document's evidence and the labels."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        host = "hot" if i % 3 == 0 else f"h{i % 17}"
        text = "plain good words of prose here. " * 3 if rng.random() < (0.9 if host in ("hot", "h1", "h2") else 0.3) else "BAD!! | 77 $$ || BAD!! " * 3
        rows.append((i, text + f"w{i}", host, "ab"[i % 2]))
    labels = [(i, int("plain" in rows[i][1])) for i in range(0, 600, 4)] + [(0, 0), (10_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    got = {r.doc_id: r for r in sq.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), Scratch(spark, "t")).collect()}
    known = {}
    for i, y in labels:
        known.setdefault(i, []).append(y)
    good = {i: np.mean(known[i]) if i in known else r.doc_prob for i, r in got.items()}

    def moments(groups):
        """groups: (n, good, rate of the parent)"""
        n = sum(g[0] for g in groups)
        between = sum(k * ((g / k - p) ** 2 - p * (1 - p) / k) for k, g, p in groups) / n
        within = np.mean([p * (1 - p) for _, _, p in groups])
        return 1e6 if between <= 0 else min(max(within / between - 1, 1.0), 1e6)

    def tally(key):
        out = {}
        for i, r in got.items():
            n, g = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, g + good[i]
        return out

    hosts, paths = tally(lambda r: r.host), tally(lambda r: (r.host, r.path))
    rate = sum(good.values()) / len(good)
    m = moments([(n, g, rate) for n, g in hosts.values()])
    m2 = moments([(n, g, (hosts[h][1] + m * rate) / (hosts[h][0] + m)) for (h, _), (n, g) in paths.items()])
    sample = [np.mean(y) for i, y in known.items() if i < 600]
    base = np.log((sum(sample) + 0.5) / (len(sample) - sum(sample) + 0.5))
    for r in got.values():
        own, (n, g), (k, w) = good[r.doc_id], hosts[r.host], paths[r.host, r.path]
        of_host = (g - own + m * (sum(good.values()) - own) / (len(good) - 1)) / (n - 1 + m)
        p = (w - own + m2 * of_host) / (k - 1 + m2)
        assert abs(r.host_posterior - of_host) < 1e-9 and abs(r.path_posterior - p) < 1e-9
        want = 1 / (1 + np.exp(-(np.log(r.doc_prob / (1 - r.doc_prob)) - base + np.log(p / (1 - p)))))
        assert abs(r.quality - want) < 1e-6 and r.keep == (r.quality >= 0.5)


def test_sites_of_urls(spark):
    urls = ["https://www.Example.com:8080/en/825?page=2", "http://user@m.site.net#top", "nothing", None, "ftp://a.b/c"]
    df = sq.with_site(spark.createDataFrame([(u,) for u in urls], "url string"), "url")
    assert [(r.host, r.path) for r in df.collect()] == [("example.com", "en"), ("m.site.net", ""), ("", ""), ("", ""), ("a.b", "c")]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "s", "en", 1), (3, "some good words here", "s", None, 2), (3, "some good words here", "s", None, 2), (4, "BAD!! BAD!! BAD!!", "t", "en", 3), (None, "some more words", "s", "en", 0)], "doc_id long, text string, source string, lang string, Row int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (3, 1), (None, 1), (9, 0), (2, None)], "doc_id long, quality int")
    got = sq.judge(docs, labels, Scratch(spark, "t")).collect()
    assert len(got) == 6 and {r.keep for r in got if r.doc_id in (1, 2)} == {False}
    kept = sq.keep_good(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()].count(3) == 2
    assert {r.keep for r in sq.judge(docs, labels.limit(0), Scratch(spark, "t")).where("doc_id >= 3").collect()} == {True}
    assert sq.judge(docs.limit(0), labels, Scratch(spark, "t")).count() == 0


def test_own_evidence_is_left_out(spark):
    """A document that is alone on its site meets the rate of all others; of two equal sites the rest decides."""
    words = "some plain good words here. " * 4
    docs = [(i, words if i % 3 else "BAD!! | 77 $$ || " * 4, f"h{i}", "p") for i in range(60)] + [(100, "fair words " * 200_000, "long", None)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 60, 2)]
    rows = sq.judge(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), Scratch(spark, "t")).collect()
    y = dict(labels)
    own = {r.doc_id: y.get(r.doc_id, r.doc_prob) for r in rows}
    assert len(rows) == 61
    for r in rows:
        rest = (sum(own.values()) - own[r.doc_id]) / 60
        assert abs(r.host_posterior - rest) < 1e-9 and abs(r.path_posterior - rest) < 1e-9
    one = sq.judge(spark.createDataFrame(docs[1:2], "doc_id long, text string, source string, lang string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), Scratch(spark, "t")).first()
    assert abs(one.path_posterior - 0.5) < 1e-9
    assert {r.keep for r in sq.op1_site_quality(spark, "/root/testdata/sf0.001").collect()} == {True, False}
