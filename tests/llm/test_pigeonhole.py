"""Edit matching against a plain dynamic programme."""

import random

import pytest

from spangrove.llm import pigeonhole as ph
from spangrove.llm.common import Scratch


def plain(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[i] = rng.choice("abcdé ")
        elif what == 1:
            s.insert(i, rng.choice("abcdé "))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60))) + edited(rng, item, rng.randrange(6)) + "cab" * 3
        want = plain(item, text)
        got = ph.myers(item, text, 8)
        assert (got[0] if got else None) == (want if want <= 8 else None)


def test_finds_all_within_budget():
    rng = random.Random(2)
    words = ["then", "thing", "ever", "ation", "ble", "of", "the", "and", "é"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 50)))) for i in range(30)]
    items = [x for x in items if len(x[1]) >= ph.MIN_CHARS]
    own = ph.Matcher([*items, (900, None), (901, ""), (902, "too short")], short=False)
    for _ in range(60):
        i, item = rng.choice(items)
        text = " ".join(rng.choice(words) for _ in range(40)) + " " + edited(rng, item, rng.randrange(5)) + " " + " ".join(rng.choice(words) for _ in range(20))
        folded = " ".join(ph.fold(text).split())
        want = {j: plain(t, folded) for j, t in items}
        assert {j: d for j, d, _ in own.find(text)} == {j: d for j, d in want.items() if d <= len(dict(items)[j]) // ph.RATE}


@pytest.mark.parametrize("held", [ph.HELD_CHARS, 0])
def test_tables(spark, held):
    scratch = Scratch(spark, "t")
    item = "The quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, "x " + item.upper().replace(" ", "\n ") + " y", 5), (2, None, 5), (3, "", 5), (4, "clean text", 5), (1, "again " + item, 6), (6, item[:40], 1), (7, "z " * 200_000 + item, 1)], "doc_id long, text string, Row int")
    items = spark.createDataFrame([(7, item), (8, None), (9, "clean"), (7, item), (None, item[3:])], "item_id long, text string")
    got = ph.matches(docs, items, scratch, short=False, held_chars=held)
    assert sorted((r.doc_id, r.item_id or 0, r.distance) for r in got.collect()) == sorted([(1, 7, 0)] * 4 + [(7, 7, 0)] * 2 + [(1, 0, 0)] * 2 + [(7, 0, 0)])
    kept = ph.decontaminate(docs, items, scratch, short=False, held_chars=held)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6] and kept.columns == docs.columns
    same = spark.createDataFrame([(1, item), (1, "clean"), (None, item), (None, "clean")], "doc_id long, text string")
    assert [r.text for r in ph.decontaminate(same, items, scratch, short=False, held_chars=held).collect()] == ["clean", "clean"]
    assert ph.matches(docs.limit(0), items, scratch, short=False, held_chars=held).count() == 0 and ph.matches(docs, items.limit(0), scratch, short=False, held_chars=held - 1).count() == 0


def test_pieces_meet_as_tables(spark):
    """Items beyond what tasks may hold give the rows that the automaton gives, short ones included."""
    rng = random.Random(4)
    words = ["then", "thing", "ever", "ation", "ble", "of", "the", "and", "é"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(30)) + " " + edited(rng, rng.choice(items)[1], rng.randrange(4)) + " the end") for i in range(80)]
    own = ph.Matcher(items, True)
    want = sorted((i, *x) for i, text in docs for x in own.find(text))
    got = ph.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"), short=True, held_chars=10)
    assert len(want) > 80 and sorted(tuple(r) for r in got.collect()) == want


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in ph.op10_pigeonhole(spark, "/root/testdata/sf0.001").collect()}
    assert want <= got
