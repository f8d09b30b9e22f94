"""An index of chunks that stays: built once, brought up to date by what has changed, read by the terms of a query.

Three tables under one folder:

    docs      id, sha256, chunks, terms, part, gen                one row for each document
    chunks    id, chunk_index, start_offset, end_offset, text     in folders by gen and by part, a hash of the id
    postings  id, chunk_index, term, tf, positions, len           in folders by gen, part and bucket, a hash of the term

A query reads the buckets of its terms and nothing else of the postings (a prefix reads all buckets); lengths stand beside
the postings, so scores need no join. An update finds unchanged documents by their hashes and writes chunks and postings of
the others under a new name, gen; docs says which gen of a document counts, and it changes last. So rows of a replaced or
deleted document are dead at once: they are left out where the tables are read, and when fewer than half of the chunks
live, those are written anew and the rest goes. A text is dealt out by its id, and its chunks and postings are made and
written where it lies.

Ids are unique: of rows that share one the first by text counts, and null ids take no part; a null text is empty, and
a document without words has a row and no chunks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cleaned, scratch_save
from . import search as se

DOCS = "id string, sha256 string, chunks long, terms long, part int"
CHUNKS = "id string, chunk_index int, start_offset int, end_offset int, text string, part int"
POSTINGS = "id string, chunk_index int, term string, tf long, positions array<int>, len int, bucket int, part int"
#: Chunks whose words are put in order at once.
AT_ONCE = 2000


def _ordered(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order by key of what stood in this order, by 16 bits at a time, which numpy sorts in linear time."""
    for shift in range(0, int(key.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def _occurrences(buckets: int):
    """A row for each chunk and different word of it, from the chunks' words in order. What is made at once stands in the
    order in which it is written, so that Spark's sort merges stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(begin, AT_ONCE)
                words = batch.column("words")
                size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                coded = words.flatten().dictionary_encode()
                terms = coded.dictionary.cast(pa.binary()).to_pylist()
                bucket = np.fromiter((zlib.crc32(t) % buckets for t in terms), np.int64, len(terms))
                ranked = _ordered(bucket, pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64))
                rank = np.empty(len(terms), np.int64)
                rank[ranked] = np.arange(len(terms))
                chunk = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size)
                term = rank[coded.indices.to_numpy(zero_copy_only=False)]
                part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
                order = _ordered(part[chunk], _ordered(term, np.arange(len(chunk))))
                key = ((part[chunk] * len(terms) + term) * len(size) + chunk)[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                ends, here = np.append(first, len(key)), chunk[order[first]]
                columns = {c: batch.column(c).take(pa.array(here)) for c in ("id", "chunk_index", "part")}
                nth = ranked[term[order[first]]]
                columns["term"] = coded.dictionary.take(pa.array(nth))
                columns["bucket"] = pa.array(bucket[nth].astype(np.int32))
                columns["tf"] = pa.array(np.diff(ends))
                columns["positions"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32)))
                columns["len"] = pa.array(size[here].astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)

    return run


@dataclass
class Index:
    spark: SparkSession
    root: str
    buckets: int = 16
    parts: int = 8
    size: int = se.SIZE
    overlap: int = se.OVERLAP

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        """All rows, dead ones too, with their gen."""
        path, fs = self._path("docs/_SUCCESS")
        if not fs.exists(path):
            return self.spark.createDataFrame([], f"{schema}, gen string")
        return self.spark.read.schema(f"{schema}, gen string").parquet(f"{self.root}/{name}")

    def _living(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._read("docs", DOCS).select("id", "gen"), ["id", "gen"], "left_semi").drop("gen")

    def docs(self) -> DataFrame:
        return self._read("docs", DOCS).drop("gen")

    def chunks(self) -> DataFrame:
        return self._living(self._read("chunks", CHUNKS))

    def postings(self) -> DataFrame:
        return self._living(self._read("postings", POSTINGS))

    def _part(self) -> Column:
        return F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(self.parts)).cast("int")

    def rebuild(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Everything anew, from these documents alone."""
        gen = uuid.uuid4().hex
        self._set(self._add(self._clean(df, id_col, text_col), gen))
        self._drop_others(gen)

    def update(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Documents that are new or have another text than before; their number is returned. Others stay."""
        new = self._clean(df, id_col, text_col)
        known = self.docs().select("id", F.col("sha256").alias("held"))
        changed = new.join(known, "id", "left").where("held is null or held <> sha256").drop("held")
        added = scratch_save(self.spark)(self._add(changed, uuid.uuid4().hex), "added")
        n = added.count()
        if n:
            self._set(self._read("docs", DOCS).join(added.select("id"), "id", "left_anti").unionByName(added))
            self._compact()
        return n

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Documents go, with their chunks and postings."""
        gone = ids.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
        self._set(self._read("docs", DOCS).join(gone, "id", "left_anti"))
        self._compact()

    def _clean(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
        return rows.groupBy("id").agg(F.min("text").alias("text")).withColumn("sha256", F.sha2("text", 256)).withColumn("part", self._part())

    def _add(self, rows: DataFrame, gen: str) -> DataFrame:
        """Write chunks and postings of these documents; their rows for docs are returned."""
        # Each task has one part or few, so it writes few files; a part is dealt to several tasks where there are many.
        shares = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.parts)
        new = scratch_save(self.spark)(rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(shares))), "new")
        self._write("chunks", gen, se.chunks(new, "id", "text", self.size, self.overlap).withColumn("part", self._part()))
        words = self._of("chunks", CHUNKS, gen).select("id", "chunk_index", "part", se.terms(F.col("text")).alias("words"))
        found = words.mapInArrow(_occurrences(self.buckets), "id string, chunk_index int, part int, term string, bucket int, tf long, positions array<int>, len int")
        self._write("postings", gen, found)
        chunks = self._of("chunks", CHUNKS, gen).groupBy("id").agg(F.count("*").alias("chunks"))
        terms = self._of("postings", POSTINGS, gen).groupBy("id").agg(F.sum("tf").alias("terms"))
        none = F.lit(0).cast("long")
        return new.drop("text").join(chunks, "id", "left").join(terms, "id", "left").select("id", "sha256", F.coalesce("chunks", none).alias("chunks"), F.coalesce("terms", none).alias("terms"), "part", F.lit(gen).alias("gen"))

    def _of(self, name: str, schema: str, gen: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/gen={gen}")

    def _write(self, name: str, gen: str, rows: DataFrame) -> None:
        by = ["part", "bucket"] if name == "postings" else ["part"]
        order = [*by, "term", "id"] if name == "postings" else [*by, "id"]
        with cleaned(self.spark):
            rows.sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}/gen={gen}")

    def _set(self, docs: DataFrame) -> None:
        """These are the documents from now on; what replaces docs is complete before the old one goes."""
        new = f"docs-{uuid.uuid4().hex}"
        with cleaned(self.spark):
            docs.repartition("part").sortWithinPartitions("id").write.parquet(f"{self.root}/{new}")
        (old, fs), (path, _) = self._path("docs"), self._path(new)
        fs.delete(old, True)
        fs.rename(path, old)

    def _compact(self) -> None:
        """Write what lives anew if that is less than half of the chunks."""
        living = self.docs().agg(F.sum("chunks")).first()[0] or 0
        if 2 * living < self._read("chunks", CHUNKS).count():
            gen = uuid.uuid4().hex
            self._write("chunks", gen, self.chunks().repartition("part"))
            self._write("postings", gen, self.postings().repartition("part", "bucket"))
            self._set(self._read("docs", DOCS).withColumn("gen", F.lit(gen)))
            self._drop_others(gen)

    def _drop_others(self, gen: str) -> None:
        for name in ("chunks", "postings"):
            path, fs = self._path(name)
            for x in fs.listStatus(path):
                if x.getPath().getName() != f"gen={gen}":
                    fs.delete(x.getPath(), True)

    def bucket_of(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets

    def matching(self, query: str) -> DataFrame:
        """Postings of the query's terms, from their buckets alone."""
        q = se.Query(query)
        rows = self.postings()
        if not q.prefixes:
            rows = rows.where(F.col("bucket").isin(sorted({self.bucket_of(t) for t in q.exact})))
        return rows.where(q.wanted(F.col("term")))

    def search(self, query: str, limit: int = 8) -> DataFrame:
        """id, chunk_index, score of the best chunks; lower is better, ties by id and place."""
        q, mine = se.Query(query), self.matching(query)
        totals = self.docs().agg(F.sum("chunks").cast("double").alias("n"), (F.sum("terms") / F.sum("chunks")).alias("average"))
        df = mine.groupBy("term").agg(F.count("*").cast("double").alias("df"))
        # One row of totals; as many counts as the query has terms (or words begin as its prefixes do, where Spark decides).
        scored = mine.join(df if q.prefixes else F.broadcast(df), "term").join(F.broadcast(totals))
        score = F.sum(se.bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("average")))
        found = scored.groupBy("id", "chunk_index").agg(score.alias("bm25"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))
        return found.where(q.holds(F.col("found"))).select("id", "chunk_index", (-F.col("bm25")).alias("score")).orderBy("score", "id", "chunk_index").limit(limit)

    def hits(self, query: str, limit: int = 8, tokens: int = 18) -> DataFrame:
        """id, chunk_index, score, snippet: the best chunks with their best windows; only the parts of the hits are read."""
        best = self.search(query, limit).withColumn("part", self._part())
        words = sorted(se.Query(query).exact)
        out = self._living(self._read("chunks", CHUNKS).join(F.broadcast(best), ["part", "id", "chunk_index"]))  # at most `limit` rows
        return out.select("id", "chunk_index", "score", best_window(F.col("text"), words, tokens).alias("snippet")).orderBy("score", "id", "chunk_index")


def best_window(text: Column, words: list[str], tokens: int = 18) -> Column:
    """The window of `tokens` words with the most different words of the query, then the most hits, then the first; hits in
    [ ], cut ends as ' ... '. The hits of each word of the query are marked once; a window adds up its marks."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    parts = F.split(se.strip(text), r"[ \t\n\r]+")

    flags = lambda p, word: F.transform(p, lambda x: F.when(plain(x) == word, F.lit(1)).otherwise(F.lit(0)))

    def chosen(z: Column) -> Column:
        p = z["p"]
        last = F.greatest(F.size(p) - tokens, F.lit(0))

        def score(s: Column) -> Column:
            counts = [F.aggregate(F.slice(z[f"w{i}"], s + 1, F.lit(tokens)), F.lit(0), lambda a, x: a + x) for i in range(len(words))]
            different = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
            return F.struct(different.alias("d"), sum(counts, F.lit(0)).alias("h"), (-s).alias("s"))

        begin = -F.array_max(F.transform(F.sequence(F.lit(0), last), score))["s"]
        mark = lambda x: F.when(plain(x).isin(*(words or [""])), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)
        shown = lambda b: F.concat(F.when(b > 0, " ... ").otherwise(""), F.array_join(F.transform(F.slice(p, b + 1, F.lit(tokens)), mark), " "), F.when(b + tokens < F.size(p), " ... ").otherwise(""))
        return F.get(F.transform(F.array(begin), shown), F.lit(0))

    row = lambda p: F.struct(p.alias("p"), *(flags(p, w).alias(f"w{i}") for i, w in enumerate(words)))
    return F.get(F.transform(F.transform(F.array(parts), row), chosen), F.lit(0))
