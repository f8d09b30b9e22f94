"""A training-data pipeline: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spangrove.llm import chosen_path, chunk_bpe, pigeonhole, secret_owners, site_quality
from spangrove.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no words and go. Rows that share or lack an id are judged one by one, equal ones alike, a
    tie at the threshold stays; other columns than those of documents are dropped; an empty table stays empty.
    """
    return site_quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id, then the first.

    Null and empty texts are like nothing and stay. Repeated rows are duplicates of each other, with ids or without.
    Other columns than those of documents are dropped; an empty table stays empty.
    """
    return chosen_path.deduplicate(docs.select(*COLUMNS), Scratch(spark, "near"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none, null and empty items are held by none. Rows are judged one by one, so repeated ones
    alike. Other columns than those of documents are dropped; an empty table on either side takes nothing out.
    """
    return pigeonhole.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"), short=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark; widely copied examples stay. n_chars is that of the new text.

    A null text stays null, its n_chars too; an empty one stays empty. Repeated rows are changed alike and all stay. Other
    columns than those of documents are dropped; an empty table stays empty.
    """
    from pyspark.sql import functions as F

    clean = secret_owners.redact(docs.select(*COLUMNS), Scratch(spark, "secrets"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, as counts and hashes of the ids and of what they decode to.

    Null and empty texts have no tokens; each row, repeated or without an id, gives a row; an empty table none.
    """
    return chunk_bpe.encode_decode(docs, "word_bpe_49k.json")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: A fitted classifier, similarity, edit distance and a tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
