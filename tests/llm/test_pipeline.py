"""The pipeline, stage by stage."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spangrove.llm.common import Scratch, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    columns = docs.columns
    truth = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    scratch = Scratch(spark, "t")
    before = len(truth)
    for name, stage in cp.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert 0 < len(rows) <= before
        before = len(rows)
        if name == "quality":
            good = [d in rows for d, q in labels.items() if q]
            assert sum(good) > 0.98 * len(good)
        if name == "near_duplicates":
            assert len({r.text for r in rows.values()}) == len(rows)
        if name == "benchmark_leaks":
            assert not any(i in r.text for r in rows.values() for i in items)
    changed = [d for d, r in rows.items() if r.text != truth[d]["text"]]
    assert changed and all("[SECRET]" in rows[d].text for d in changed)
    out = cp.STAGES[-1][1](spark, docs, SF)
    assert out.count() == before and cp.run(spark, SF).count() == before


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, ties, clashing extra columns and empty tables, in each stage by itself."""
    import corpus_pipeline as cp

    good = " ".join(f"word{i} and some plain prose" for i in range(40))
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, good + " more", "en", "b", 1), (5, "two words", "en", "a", 9), (6, "token = q8ZkfT0vLm3xWn5R", "en", "c", 1), (7, "x " * 200_000, "de", "a", 400_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, "two words"), (8, None), (7, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).withColumn("Row", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("Rid", F.lit(2))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if name != "tokens":
            assert none.columns == cp.COLUMNS
        got = sorted((r.doc_id or 0 for r in out))
        if name == "near_duplicates":
            assert got == [1, 2, 3, 5, 6, 7]
        elif name == "benchmark_leaks":
            assert got == [0, 1, 1, 2, 3, 6, 7]
        elif name == "secrets":
            assert got == [0, 1, 1, 2, 3, 5, 6, 7] and {r.text for r in out if r.doc_id == 6} == {"[SECRET]"} and {r.text for r in out if r.doc_id == 2} == {None}
        elif name == "tokens":
            assert got == [0, 1, 1, 2, 3, 5, 6, 7] and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in e.queries() if q.startswith("op")}
    assert "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
