"""Token files, token counts and chunked BPE against the tokenizers library itself."""

import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from spangrove.llm import chunk_bpe, simple8b, token_counts
from spangrove.llm.common import Scratch
from spangrove.llm.units import load_tokenizer

TEXTS = [
    "Hello, world! it's the first one.\nA second  line\t\ttabs \n\n",
    "",
    None,
    " leading and trailing ",
    "ñandú Éclair ÜBER straße 1234 56.78 a_b c-d e'll we've I'm '",
    "no break  em space   x　y \u0085 z",
    "é combining ́start and a ́b",
    "<|endoftext|> in text<|endoftext|>. <|startoftext|>x word<|startoftext|>",
    "😀 emoji 👩‍👩‍👧 zwj, ok!! the!! end%%% a;b:c.d,e?f!g#h",
    "x" * 5000,
    "the same chunk of words again and again " * 200,
    "the same chunk of words again and again " * 200 + "tail",
    "İstanbul ΑΣ ΣΑΣ ﬁne ǅ",
    "Hello, world! it's the first one.\nA second  line\t\ttabs \n\n",
    "\x00\x1f control \x1c chars \x7f",
    "\n", " ", "\n\n \n", "a", "é.", "×. ÷, ß!",
]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


#: Words that polynomial hashes modulo 2**64 cannot tell apart, and a long text.
TEXTS += [thue_morse(n, flip) for n in (1024, 2048, 4096) for flip in (False, True)]
TEXTS += [("word after word, " * 90_000) + "end", "q" * 300_000 + " " + "日本" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, Text_Hash int").repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts(spark, docs, name):
    tok = load_tokenizer(name)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs.unionByName(docs.limit(3)), name, limit=100).collect()}
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 100), r.text


def test_counts_come_from_batches_of_texts(monkeypatch):
    calls = []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append(texts)
            return [[0] * len(t) for t in texts]

    buf = np.frombuffer(b"one text and another one", np.uint8)
    counter = token_counts.Counter(Counting())
    assert counter.lengths(buf, np.array([0, 9, 24])).tolist() == [9, 15]
    assert counter.lengths(buf, np.array([0, 9, 24])).tolist() == [9, 15]
    assert calls == [["one text ", "and another one"], []]


def test_counts_of_cut_texts():
    from spangrove.llm.common import arrow_bytes

    buf, offsets = arrow_bytes(pa.array(TEXTS))
    seen = b"".join(bytes(p) for p, _, _ in token_counts.balanced(buf, offsets, 64))
    assert seen == bytes(buf)


@pytest.mark.parametrize("mask", [0, 3, 31])
@pytest.mark.parametrize("name,spaced,memo", [("word_bpe_49k.json", False, False), ("word_bpe_49k.json", False, True), ("byte_bpe_50k.json", True, False)])
def test_joins_are_repaired(mask, name, spaced, memo, monkeypatch):
    from spangrove.llm.common import arrow_bytes

    monkeypatch.setattr(chunk_bpe, "MASK", np.uint64(mask))
    monkeypatch.setattr(chunk_bpe, "WINDOW", 4)
    tok = load_tokenizer(name)
    some = [t for t in TEXTS if len(t or "") < 10_000]
    buf, offsets = arrow_bytes(pa.array(some))
    for text, ids in zip(some, chunk_bpe.ChunkEncoder(tok, spaced, memo=chunk_bpe.UnitMemo(name, spaced) if memo else None).rows(buf, offsets), strict=True):
        assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


def test_stretches_grow_until_they_agree(monkeypatch):
    """A tokenizer that makes one token of each run of words in capitals, however long."""

    class Runs:
        def encode_batch_fast(self, texts, add_special_tokens):
            found = [re.findall(r"[A-Z]+(?: [A-Z]+)*|[a-z]+", t) for t in texts]
            return [type("E", (), {"ids": [zlib.crc32(x.encode()) >> 2 for x in w]}) for w in found]

    monkeypatch.setattr(chunk_bpe, "MASK", np.uint64(31))
    monkeypatch.setattr(chunk_bpe, "WINDOW", 4)
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.integers(3, 9)))
    words = [w.upper() if i // 7 % 3 == 0 else w for i, w in enumerate(word() for _ in range(3000))]
    text = " ".join(words)
    encoder = chunk_bpe.ChunkEncoder(Runs())
    got = encoder.rows(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist()
    # Cuts between words tear such runs too, which is why only tokenizers that never merge across white space will do.
    torn = lambda ids: len(set(ids))
    assert encoder.grown > 0 and torn(got) > 0


def test_chunks(spark, docs):
    tok = load_tokenizer("word_bpe_49k.json")
    for row in chunk_bpe.encode_decode(docs, "word_bpe_49k.json", with_ids=True).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = tok.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids, row.text
        assert row.decoded == tok.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids) and row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(row.decoded.encode()).hexdigest()


def test_chunks_are_reused():
    encoder = chunk_bpe.ChunkEncoder(load_tokenizer("word_bpe_49k.json"))
    raw = np.frombuffer((" ".join(f"w{i * i}" for i in range(3000))).encode(), np.uint8)
    one = encoder.rows(raw, np.array([0, len(raw)]))[0]
    used, coded = encoder.reused, encoder.encoded
    two = encoder.rows(np.append(raw[:100], raw), np.array([0, 100, 100 + len(raw)]))
    assert np.array_equal(two[1], one) and encoder.reused > used + 20 and encoder.encoded < coded + 10


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1], [2**63, 5, 2**62, 2**64 - 1, 0, 0], [0] * 500, list(range(9000)), [1 << (i % 64) for i in range(6000)], [3] * 119 + [2**60]])
def test_simple8b_round_trip(values):
    block = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(block).tolist() == values
    if values == [0] * 500:
        assert len(block) < 64


def test_token_files(spark, docs):
    tok = load_tokenizer("byte_bpe_50k.json")
    tokens = simple8b.write_tokens(docs, Scratch(spark, "t"), "byte_bpe_50k.json", True, 2)
    start = 0
    got = simple8b.read_tokens(tokens).orderBy("start").collect()
    want = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert len(got) == len(want)
    for r, (doc, text) in zip(got, want, strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none, "word_bpe_49k.json").count() == 0
    assert chunk_bpe.encode_decode(none, "word_bpe_49k.json").count() == 0
    assert simple8b.read_tokens(simple8b.write_tokens(none, Scratch(spark, "t"), "byte_bpe_50k.json", True, 2)).count() == 0


def test_queries_equal_the_library(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    word, byte = load_tokenizer("word_bpe_49k.json"), load_tokenizer("byte_bpe_50k.json")
    counted = {r.doc_id: r for r in token_counts.op6_token_counts(spark, sf).collect()}
    chunked = {r.doc_id: r for r in chunk_bpe.op7_chunk_bpe(spark, sf).collect()}
    filed = {r.doc_id: r for r in simple8b.op3_simple8b(spark, sf).collect()}
    start = 0
    for doc, text in rows:
        ids = word.encode(text, add_special_tokens=False).ids
        assert counted[doc].n_tokens == chunked[doc].n_tokens == len(ids)
        assert chunked[doc].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert chunked[doc].decoded_sha256 == sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        ids = [*byte.encode(text, add_special_tokens=False).ids, 2]
        assert (filed[doc].start, filed[doc].n_tokens, filed[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
