"""Personal data: base spans against plain patterns, estimation, and the query's columns."""

import math
import re
import time
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spangrove.llm import pii
from spangrove.llm.common import Scratch

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("a@.1+ -()2é", max_size=40))
def test_base_equals_plain_patterns(text):
    assert sorted(pii.base_spans(text)) == plain(text)


def test_numbers_next_to_digits():
    text = "x +1 (826) 555-4081 190.137.2.3 y 4785380592391139 24 z"
    base, cands = pii.candidates(text)
    assert base == plain(text)
    found = {(pii.KINDS[k], text[s:e]) for s, k, e, _ in cands}
    assert ("tel", "+1 (826) 555-4081") in found and ("ip", "190.137.2.3") in found
    wide = "4785380592391139 4785380592391139"
    assert {(pii.KINDS[k], s) for s, k, e, _ in pii.candidates(wide)[1]} == ({("pan", 0), ("pan", 17)} if pii.luhn("4785380592391139") else set())
    assert pii.candidates("1" * 500)[1] == []


def test_luhn():
    assert pii.luhn("4785380592391139") == (sum(int(c) if i % 2 else sum(map(int, str(2 * int(c)))) for i, c in enumerate("4785380592391139")) % 10 == 0)


def test_reliabilities_recover_accuracies():
    rng = np.random.default_rng(0)
    n = 20_000
    truth = rng.random(n) < 0.4
    accuracy = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(n) < a, truth, ~truth) * 2 for a in accuracy], axis=1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    _, table = pii.reliabilities(np.zeros(len(rows), int), rows, counts)
    assert np.allclose(table[1, 0, :, 2], accuracy, atol=0.03)


def test_query_columns(spark):
    texts = ["Contact: jane.doe@mail.com or +49 170 1234567, ip 10.2.3.4", None, "", "email: bob (at) site (dot) org, phone 030 1234 5678", "call James Miller at 555-867-5309", "version 1.2.3.4567", "jane@x.org " * 3000]
    df = spark.createDataFrame([(i, t, "b", i) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, base string, cands int")
    found = pii.find(df, Scratch(spark, "t")).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        want = plain((texts + texts[:1])[r.doc_id] or "")
        assert r.base == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [(c.start, c.kind, c.end) for c in r.spans if c.kind < pii.BASE] == want
    extra = {pii.KINDS[c.kind] for r in found for c in r.spans}
    assert "mail_words" in extra and "person" in extra
    assert pii.find(df.limit(0), Scratch(spark, "t")).count() == 0


def test_time_is_linear():
    texts = ["1 " * 100_000, "+1 " + "234 " * 50_000, "1" * 200_000, "a." * 100_000 + "(at)", "a@" * 100_000, "Ab " * 60_000, "(at)a." * 32_000, "12-" * 60_000, "1.1" * 60_000, "A" * 200_000, "DE" * 100_000, "tel 030 1234 5678 " * 10_000]
    for text in texts:
        began = time.process_time()
        pii.candidates(text)
        assert time.process_time() - began < 4, text[:20]


def test_spelled_emails():
    found = lambda t: [t[s:e] for s, _, e in pii.spelled_emails(t)]
    assert found("mail bob.x (at) site (dot) org, ann[at]b.com (at) nobody") == ["bob.x (at) site (dot) org", "ann[at]b.com"]
    assert found("(at) site.org") == [] and found("._-a (at) b.c") == ["a (at) b.c"]


def test_one_round_of_estimation_by_hand():
    """Two kinds of votes on one kind: priors, tables and posteriors of one round, written out."""
    votes = np.array([[2, 2, 1, 1], [0, 1, 1, 1], [2, 0, 1, 1]])
    counts = np.array([6, 3, 1])
    post, table = pii.reliabilities(np.zeros(3, int), votes, counts, rounds=1)
    start = [1 / (1 + math.exp(-2 * s)) for s in (2, -1, 0)]
    prior = (sum(p * c for p, c in zip(start, counts, strict=True)) + 1) / 12
    lean = {0: [4, 3, 1], 1: [1, 3, 4]}
    want = {}
    for y in (0, 1):
        weight = [(p if y else 1 - p) * c for p, c in zip(start, counts, strict=True)]
        for j in range(4):
            got = [lean[y][v] + sum(w for w, x in zip(weight, votes, strict=True) if x[j] == v) for v in range(3)]
            want[y, j] = [g / sum(got) for g in got]
            assert np.allclose(table[y, 0, j], want[y, j])
    for i, x in enumerate(votes):
        odds = prior / (1 - prior) * math.prod(want[1, j][v] / want[0, j][v] for j, v in enumerate(x))
        assert abs(post[i] - odds / (1 + odds)) < 1e-9


def test_span_decisions_follow_the_posteriors():
    """Person candidates with a listed name and context are taken, those that the gazetteer denies are not."""
    number = lambda votes: sum((v + 1) * 3 ** (3 - i) for i, v in enumerate(votes)) << pii.FEATURES
    person = pii.KINDS.index("person")
    good, bad = number((0, 1, 1, 1)), number((0, -1, -1, 0))
    taken = pii.accepted([(person, good, 500), (person, bad, 700), (0, number((1, 1, 1, 0)), 50)])
    assert person * pii.PATTERNS + good in taken and person * pii.PATTERNS + bad not in taken
    x = pii.design(np.array([person, person]), *pii.unpack(np.array([good, bad])))
    w = pii.span_classifier(x, np.array([0.95, 0.05]), np.array([500, 700]))
    p = 1 / (1 + np.exp(-x @ w))
    assert abs(p[0] - 0.95) < 0.03 and abs(p[1] - 0.05) < 0.03


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op2_weak_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(texts[r.doc_id])]
        assert r.base_sha256 == sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if x.split(":")[0] in PLAIN] == want
