"""The prefix trie against plain dictionaries and against its SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest

from spangrove.llm import prefix_trie as pt
from spangrove.llm.common import Scratch


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows, rebuild=True):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        seq = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, v in members.items():
        ends = ",".join(map(str, sorted(c for c, e in v if e)))
        parent = min(c for c, _ in members[k[:-1]]) if k else None
        out.append((min(c for c, _ in v), len(k), parent, len(v), children[k], leaves[k], saved[k], sha256(ends.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, key int, words string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)


def check(spark, rows, monkeypatch=None, parts=None):
    if parts:
        monkeypatch.setattr(pt, "partitions", lambda df: parts)
    df = pt.trie(pt.rebuilt(pt.turn_arrays(frame(spark, rows))), Scratch(spark, "t"))
    assert got(df) == brute(rows)


def varied(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 == 3:
            continue
        for t in range(rnd.choice([0, 1, 2, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a b c", "", None, "é\tx\x0by z", "q" * 30])))
    return rows


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_random_conversations(spark, monkeypatch, parts):
    check(spark, varied(parts), monkeypatch, parts)


def test_copies_spread_over_partitions(spark, monkeypatch):
    """A third of all conversations alike, prefixes of them, and one much longer one."""
    turns = [("user", "hello there"), ("assistant", "hi"), ("user", "and so on")]
    rows = [(c, t, *turns[t]) for c in range(0, 1800, 20) for t in range(1 + c // 20 % 3)]
    rows += [(5000, t, "user", f"turn {t % 7}") for t in range(300)] + [(5020, t, "user", f"turn {t % 7}") for t in range(299)]
    check(spark, rows, monkeypatch, 30)


def test_odd_rows(spark):
    twice = [(3, 0, "user", "x y"), (3, 0, "user", "x y"), (3, None, None, None), (3, 1, "a", "b"), (None, 0, "user", "lost"), (20, 0, "user", "long " * 200_000), (21, 5, "user", "z"), (-7, 0, "user", "x y"), (40, None, "", "")]
    check(spark, twice)
    check(spark, [(3, 0, "user", "ab"), (3, 1, "use", "rab")])  # role and text don't run together
    assert pt.trie(pt.rebuilt(pt.turn_arrays(frame(spark, [(1, 0, "a", "b")]).limit(0))), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    import pyarrow.parquet as pq

    path = f"/root/testdata/{sf}"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{path}/conversations.parquet").to_pylist()]
    df = pt.op11_prefix_trie(spark, path)
    found = got(df)
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    out = con.execute(pt.SQL11)
    names = [d[0] for d in out.description]
    assert Counter(tuple(r[names.index(c)] for c in df.columns) for r in out.fetchall()) == found


def test_common():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice(b"xy") for _ in range(rnd.randrange(9))] for _ in range(2))
        want = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert pt.common(b"".join(bytes([x]) * 16 for x in a), b"".join(bytes([x]) * 16 for x in b)) == want
