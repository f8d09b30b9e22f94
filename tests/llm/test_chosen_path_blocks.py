"""Blocks of a bucket without members."""

import pytest

from spangrove.llm import chosen_path as cp


@pytest.mark.parametrize("empty", [0, 1])
def test_links_count_once(spark, empty):
    text = " ".join(f"w{i}" for i in range(60))
    own = 1 - empty
    places = [(own, own, 0), (0, 1, int(own == 1))]
    rows = [(1, 0, 1, i, j, side, rep, None, 1, [7] * cp.ROUND, t) for i, j, side in places for rep, t in ((10, text), (11, text + " more"))]
    df = spark.createDataFrame(rows, "bucket long, run int, depth int, i int, j int, side int, rep long, core long, copies long, keys array<long>, text string")
    found = cp.brute_force(df.coalesce(1).sortWithinPartitions("bucket", "i", "j"), 2).collect()
    assert sorted((r.rep, r.links) for r in found) == [(10, 1), (11, 1)]
