"""Bracket pairs against a plain stack."""

import random
import re

from spangrove.operators.brackets import CLOSERS, OPENERS, pairs


def plain(text):
    stack, out = [], []
    for m in re.finditer(r'"(?:[^"\\\n]|\\.)*"?|[()\[\]{}]', text or "", re.S):
        if m[0] in OPENERS:
            stack.append((m.start(), m[0]))
        elif m[0] in CLOSERS and stack:
            at, mark = stack.pop()
            out.append((at, m.start(), len(stack) + 1, OPENERS.index(mark) == CLOSERS.index(m[0])))
    return sorted(out + [(at, None, n + 1, None) for n, (at, _) in enumerate(stack)], key=lambda x: x[0])


def test_pairs(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice('()[]{}ab"\\\n😀') for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += [None, "", ")(", "(" * 3000 + ")" * 2999, 'f("(", [1])', '"open (\n(x)', "é(😀)"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id long, text string, depth int, at int")
    got = {}
    for r in pairs(df, ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.depth, r.alike))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=lambda x: x[0]) == plain(t), t
    assert pairs(df.limit(0), ["id"], "text").count() == 0
