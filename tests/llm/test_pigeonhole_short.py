"""Items too short for edits."""

import corpus_pipeline
from spangrove.llm import pigeonhole as ph
from spangrove.llm.common import Scratch

DOCS = [(1, "Say: what  is\nLOVE? ok"), (2, "what is loveliness"), (3, "What is love"), (4, "somewhat is love"), (5, None), (6, "clean")]
ITEMS = [(7, "What is love"), (8, " "), (9, None), (10, "love?")]


def test_short_items(spark, tmp_path):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = ph.op10_pigeonhole(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 7, 0, 17), (1, 10, 0, 18), (3, 7, 0, 12)]
    assert sorted(r.doc_id for r in ph.decontaminate(docs, items, Scratch(spark, "t"), short=True).collect()) == [2, 4, 5, 6]
    assert "short=True" in open(corpus_pipeline.__file__).read()


def test_edits_follow_the_rate(spark):
    """An item of 16 to 23 characters has the one edit that the rate gives it, one of fewer none, in both ways to hits."""
    items = spark.createDataFrame([(1, "what is love, hm?"), (2, "fifteen letters")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is lobe, hm? yes"), (2, "what is lobe, hn?"), (3, "of fifteen letterz"), (4, "fifteen letters!"), (5, "what is love, hm? " * 20_000)], "doc_id long, text string")
    for held in (ph.HELD_CHARS, 0):
        got = ph.matches(docs, items, Scratch(spark, "t"), held_chars=held).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 1), (4, 2, 0), (5, 1, 0)]
