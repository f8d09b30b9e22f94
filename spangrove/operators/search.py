"""Chunks of documents, an inverted index over them, and ranked search.

Everything is DataFrame work: chunks are a generated table, postings one aggregation, a query filters the postings
by its terms and takes the best with a bounded sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SIZE, OVERLAP = 1400, 250
#: Fixed values of BM25.
K1, B = 1.2, 0.75


def steps(size: int, overlap: int) -> int:
    """How far windows lie apart; an overlap not below the size counts as a quarter of it."""
    if overlap >= size:
        overlap = size // 4
    return max(1, size - overlap)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk_index, start_offset, end_offset, text: stripped windows with the offsets of the whole ones.

    The last window is the first that reaches the end. Blank windows go before counting. size <= 0 gives none.
    """
    text, n = F.coalesce(F.col(text_col), F.lit("")), F.length(F.coalesce(F.col(text_col), F.lit("")))
    step = steps(size, overlap) if size > 0 else 1
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    starts = F.when((n > 0) & F.lit(size > 0), F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start_offset"), F.least(s + size, n).alias("end_offset"), strip(text.substr(s + 1, F.lit(max(size, 0)))).alias("text")))
    full = F.filter(windows, lambda w: F.length(w["text"]) > 0)
    return docs.select(id_col, F.posexplode(full).alias("chunk_index", "w")).select(id_col, "chunk_index", "w.start_offset", "w.end_offset", "w.text")


def terms(text: Column) -> Column:
    """Small words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(chunked: DataFrame, *ids: str) -> DataFrame:
    """ids, term, tf, positions."""
    words = chunked.select(*ids, F.posexplode(terms(F.col("text"))).alias("at", "term"))
    return words.groupBy(*ids, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"))


def lengths(chunked: DataFrame, *ids: str) -> DataFrame:
    return chunked.select(*ids, F.size(terms(F.col("text"))).alias("len"))


class Query:
    """Terms, "phrases", prefix*, AND (or nothing between), OR, NOT and brackets, over the positions of a chunk."""

    def __init__(self, text: str):
        self.tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', text)
        self.at = 0
        self.exact: set[str] = set()
        self.prefixes: set[str] = set()
        self.tree = self._or() if self.tokens else None
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _or(self):
        out = self._and()
        while self._peek() == "OR":
            self.at += 1
            out = ("or", out, self._and())
        return out

    def _and(self):
        out = self._one()
        while self._peek() not in (None, "OR", ")"):
            kind = "and"
            if self._peek() in ("AND", "NOT"):
                kind = {"AND": "and", "NOT": "not"}[self._peek()]
                self.at += 1
            out = (kind, out, self._one())
        return out

    def _one(self):
        t = self._peek()
        if t is None or t in ("OR", "AND", "NOT", ")"):
            raise ValueError("a term is missing")
        self.at += 1
        if t == "(":
            out = self._or()
            if self._peek() != ")":
                raise ValueError("a bracket is open")
            self.at += 1
            return out
        words = re.findall("[a-z0-9]+", t.lower())
        if not words:
            raise ValueError(f"no word in {t!r}")
        if t.endswith("*"):
            self.prefixes.add(words[-1])
            self.exact.update(words[:-1])
            return ("prefix", words)
        self.exact.update(words)
        return ("phrase", words)

    def wanted(self, term: Column) -> Column:
        out = term.isin(*sorted(self.exact)) if self.exact else F.lit(False)
        for p in sorted(self.prefixes):
            out = out | term.startswith(p)
        return out

    def holds(self, found: Column, node=None) -> Column:
        """found: map from term to positions in a chunk."""
        node = node or self.tree
        kind = node[0]
        if kind in ("and", "or", "not"):
            a, b = self.holds(found, node[1]), self.holds(found, node[2])
            return a & b if kind == "and" else a | b if kind == "or" else a & ~b
        words = node[1]
        places = lambda w: F.coalesce(F.try_element_at(found, F.lit(w)), F.array().cast("array<int>"))
        if kind == "prefix":
            last = F.flatten(F.map_values(F.map_filter(found, lambda t, _: t.startswith(words[-1]))))
            ends = F.coalesce(last, F.array().cast("array<int>"))
        else:
            ends = places(words[-1])
        for back, w in enumerate(reversed(words[:-1]), 1):
            here = places(w)
            ends = _follow(ends, here, back)
        return F.size(ends) > 0


def _follow(ends: Column, here: Column, back: int) -> Column:
    return F.filter(ends, lambda p: F.array_contains(here, p - back))


def bm25(tf: Column, length: Column, df: Column, n: Column, average: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def search(index: DataFrame, sizes: DataFrame, query: str, ids: list[str], limit: int = 8) -> DataFrame:
    """ids and score of the best chunks; lower is better, ties by ids. index: postings, sizes: lengths."""
    q = Query(query)
    totals = sizes.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("average"))
    mine = index.where(q.wanted(F.col("term")))
    df = mine.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    n, average = totals.first()
    scored = mine.join(df, "term").join(sizes, ids)
    found = scored.groupBy(*ids).agg(F.sum(bm25(F.col("tf"), F.col("len"), F.col("df"), F.lit(n or 0.0), F.lit(average or 1.0))).alias("bm25"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))
    return found.where(q.holds(F.col("found"))).select(*ids, (-F.col("bm25")).alias("score")).orderBy("score", *ids).limit(limit)


def matching(index: DataFrame, query: str, ids: list[str]) -> DataFrame:
    """ids of all chunks that a query holds for, unranked. index: postings. A query that only denies finds nothing."""
    q = Query(query)
    found = index.where(q.wanted(F.col("term"))).groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))
    return found.where(q.holds(F.col("found"))).select(*ids)


def snippet(text: Column, words: list[str], tokens: int = 18) -> Column:
    """A window of words around the first hit, hits in [ ], cut ends as ' ... '."""
    parts = F.split(strip(text), r"(?U)\s+")
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    hit = lambda x: plain(x).isin(*words)
    first = F.coalesce(F.array_position(F.transform(parts, lambda x: hit(x)), True), F.lit(1))
    begin = F.greatest(F.least(first - tokens // 2, F.size(parts) - tokens + 1), F.lit(1)).cast("int")
    window = F.transform(F.slice(parts, begin, tokens), lambda x: F.when(hit(x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return F.concat(F.when(begin > 1, " ... ").otherwise(""), F.array_join(window, " "), F.when(begin + tokens <= F.size(parts), " ... ").otherwise(""))


def hits(docs: DataFrame, chunked: DataFrame, query: str, limit: int = 8, id_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """path, chunk_index, score, snippet: search joined back to its chunks and documents."""
    ids = [id_col, "chunk_index"]
    best = search(postings(chunked, *ids), lengths(chunked, *ids), query, ids, limit)
    words = sorted(Query(query).exact)
    out = best.join(chunked, ids).join(docs.select(id_col, path_col), id_col)
    return out.select(path_col, "chunk_index", "score", snippet(F.col("text"), words or [""]).alias("snippet")).orderBy("score", path_col, "chunk_index")

