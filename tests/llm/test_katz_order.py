"""Katz backoff of any order against a recursive model in dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_katz import Plain, tokens

from spangrove.llm import katz
from spangrove.llm.common import Scratch


class Recursive:
    def __init__(self, docs, order):
        self.order, self.seen = order, [defaultdict(Counter) for _ in range(order)]
        for i, t in docs:
            if not katz.is_held_out(i):
                for h, w in self.walk(t):
                    for n in range(order):
                        self.seen[n][h[order - 1 - n :]][w] += 1
        self.d = [Plain.discounts(Counter(c for x in level.values() for c in x.values())) for level in self.seen]
        self.cache = {}

    def walk(self, text):
        h = ("<s>",) * (self.order - 1)
        for w in tokens(text):
            yield h, w
            h = (*h, w)[1:]

    def p(self, h, w):
        if h not in self.cache:
            counts, total = self.seen[len(h)].get(h, {}), sum(self.seen[len(h)].get(h, {}).values())
            p, left = Plain.level(self, counts, self.d[len(h)]) if total else ({}, 1.0)
            self.cache[h] = p, left / (1 - sum(self.p(h[1:], x) for x in p)) if h else left
        p, a = self.cache[h]
        return p[w] if w in p else a * self.p(h[1:], w) if h else a


@pytest.mark.parametrize("order,hot,block", [(1, 1 << 18, 900), (2, 3, 50), (3, 1 << 18, 1_200_000), (3, 3, 50), (3, 40, 300), (4, 25, 300)])
def test_against_recursion(spark, order, hot, block):
    rng = np.random.default_rng(1)
    words = ["The", "the", "of", "AND", "é", "x1"] + [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=(p := 1 / np.arange(1, len(words) + 1)) / p.sum()))) for i in range(150)]
    # b is always followed by c, c by d, more than K times: histories without discounted mass.
    docs += [(i, "a b c d") for i in range(200, 260)] + [(i, "a b the of c") for i in range(260, 290) if katz.is_held_out(i)]
    docs += [(500, None), (501, ""), (502, "unheard words only\tthe\vend"), (None, "the of")]
    model = Recursive(docs, order)
    got = katz.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), Scratch(spark, "t"), hot=hot, block_tokens=block, order=order).collect()
    assert len(got) == len(docs)
    want = {i: sum(math.log10(model.p(h, w)) for h, w in model.walk(t)) for i, t in docs}
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9 * max(1, abs(r.score)), r
    for t in ("the of the", "a b c", "x1 w3 unheard"):
        for h, _ in model.walk(t):
            assert abs(sum(model.p(h, w) for w in [*model.seen[0][()], "an unseen word"]) - 1) < 1e-9


def test_op4_sees_two_words_back(spark, tmp_path):
    ids = [i for i in range(400) if not katz.is_held_out(i)][:100]
    held = [i for i in range(400) if katz.is_held_out(i)][:2]
    docs = [(i, "p x y" if i % 2 else "q x z") for i in ids] + [(held[0], "p x y"), (held[1], "p x z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in katz.op4_katz(spark, str(tmp_path)).collect()}
    assert score[held[0]] > score[held[1]] + 1
