"""The stored index: what an update or a deletion leaves equals an index built anew; a query reads its buckets."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spangrove.operators import search
from spangrove.operators.index_store import Index, _occurrences, best_window


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.fixture
def make(spark, tmp_path):
    n = iter(range(99))
    return lambda: Index(spark, f"file://{tmp_path}/{next(n)}", buckets=4, parts=3, size=60, overlap=10)


DOCS = [(i, f"word{i % 5} common text {'rare ' * (i % 3)} number {i} and more of it, so that there are two chunks") for i in range(30)] + [(30, ""), (31, None), (None, "no id"), (32, " \n ")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def same(a, b):
    for x, y in ((a.docs(), b.docs()), (a.chunks(), b.chunks()), (a.postings(), b.postings())):
        assert rows(x) == rows(y)


def test_update_and_delete_equal_a_fresh_build(spark, make):
    old = [(i, t if i is None or i % 4 else "an old text of other words") for i, t in DOCS if i is None or i < 20 or i > 29]
    kept, fresh = make(), make()
    kept.rebuild(frame(spark, old))
    fresh.rebuild(frame(spark, DOCS))
    assert fresh.docs().count() == 33
    assert kept.update(frame(spark, DOCS)) == 5 + 1 + 10
    same(kept, fresh)
    assert kept.update(frame(spark, DOCS)) == 0
    gone = [d for d in DOCS if d[0] is not None and d[0] % 3 != 1]
    kept.delete(frame(spark, [d for d in DOCS if d not in gone]))
    fresh.rebuild(frame(spark, gone))
    same(kept, fresh)
    kept.delete(frame(spark, DOCS))
    assert kept.docs().count() == kept.postings().count() == kept.chunks().count() == 0
    assert kept.hits("common").count() == 0


def test_search_as_without_an_index(spark, make):
    index, df = make(), frame(spark, DOCS)
    index.rebuild(df)
    chunked = search.chunks(df.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("id"), "text"), "id", "text", 60, 10)
    for query in ("rare common", '"rare rare" OR word3', "wor* NOT rare", "absent"):
        want = search.search(search.postings(chunked, "id", "chunk_index"), search.lengths(chunked, "id", "chunk_index"), query, ["id", "chunk_index"])
        got = [(r.id, r.chunk_index, round(r.score, 9)) for r in index.search(query).collect()]
        assert got == [(r.id, r.chunk_index, round(r.score, 9)) for r in want.collect()], query
    plan = index.matching("rare common")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "bucket" in filters and {index.bucket_of("rare"), index.bucket_of("common")} == {int(x) for x in __import__("re").findall(r"(?<=[ (,])\d+(?=[,)])", filters)}


def test_empty_table(spark, make):
    index = make()
    index.rebuild(frame(spark, DOCS).limit(0))
    assert index.hits("word").count() == 0
    assert index.update(frame(spark, DOCS[:2])) == 2 and index.docs().count() == 2


def test_best_window(spark):
    text = "a the b c d e f g h i j k l the m of, n o"
    out = lambda t, words, n: spark.createDataFrame([(t,)], "t string").select(best_window(F.col("t"), words, n)).first()[0]
    assert out(text, ["the", "of"], 4) == " ... l [the] m [of,] ... "
    assert out(text, ["the"], 4) == "a [the] b c ... "
    assert out("short text", ["the"], 18) == "short text" and out("", ["x"], 3) == ""


def test_an_update_writes_its_own_rows_only(spark, make):
    """Before, all rows of every part that held a changed document were written anew."""
    index = make()
    index.rebuild(frame(spark, DOCS))
    before = {f for t in ("chunks", "postings") for f in index._read(t, "id string").inputFiles()}
    assert index.update(frame(spark, [(3, "another text"), *DOCS[4:]])) == 1
    now = {f for t in ("chunks", "postings") for f in index._read(t, "id string").inputFiles()}
    assert before < now and len(now - before) == 3
    assert [r.text for r in index.chunks().where("id = '3'").collect()] == ["another text"]
    assert sorted(r.term for r in index.postings().where("id = '3'").collect()) == ["another", "text"]
    assert "gen" not in index.docs().columns + index.chunks().columns + index.postings().columns


def test_dead_rows_go_when_they_are_most(spark, make):
    index = make()
    index.rebuild(frame(spark, DOCS))
    index.delete(frame(spark, DOCS[:20]))
    assert index._read("chunks", "id string").select("id").distinct().count() == index.chunks().select("id").distinct().count() == 10
    assert index.docs().agg(F.sum("terms")).first()[0] == index.postings().agg(F.sum("tf")).first()[0]


def test_words_in_the_order_of_their_files():
    """More different words than 16 bits number, and several parts in a batch."""
    words = [[f"w{i}" for i in range(70_000)] + ["w5"], [], ["w5", "a", "w5"]]
    batch = pa.RecordBatch.from_pydict({"id": ["x", "y", "z"], "chunk_index": pa.array([0, 0, 0], pa.int32()), "part": pa.array([1, 0, 0], pa.int32()), "words": words})
    found = [r for b in _occurrences(4)([batch]) for r in b.to_pylist()]
    assert [(r["part"], r["bucket"], r["term"], r["id"]) for r in found] == sorted((r["part"], r["bucket"], r["term"], r["id"]) for r in found)
    assert len(found) == 70_002 and all(r["bucket"] == zlib.crc32(r["term"].encode()) % 4 for r in found)
    assert {(r["id"], r["term"]): (r["tf"], r["positions"], r["len"]) for r in found if r["term"] in ("a", "w5")} == {("x", "w5"): (2, [5, 70_000], 70_001), ("z", "w5"): (2, [0, 2], 3), ("z", "a"): (1, [1], 3)}
