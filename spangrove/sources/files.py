"""Source trees, grammars with their messages, and plain-text sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.grammar import Grammar, compile_grammar
from .scratch import scratch_save

#: Which files make the index, and which folders do not.
SUFFIXES = (".txt", ".md", ".swift", ".grammar", ".gv")
EXCLUDED = (".git", ".build", "DerivedData", "Products")
#: Tried in this order.
ENCODINGS = ("utf-8", "mac_roman", "iso-8859-1", "iso-8859-2", "ascii", "utf-16", "utf-16-be", "utf-16-le", "utf-32", "utf-32-be", "utf-32-le", "windows-1250", "windows-1251", "windows-1252", "windows-1253", "windows-1254")


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path (below root), sha256, size, mtime, text of every file; bytes that aren't UTF-8 become replacement marks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://").rstrip("/") + "/"
    below = F.element_at(F.split(F.col("path"), base, 2), -1)
    suffix = F.lower(F.regexp_extract(below, r"(\.[^./]+)$", 1))
    keep = suffix.isin(*suffixes) & ~F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, excluded)))
    # The path decides before any content is read.
    kept = files.select("path", "modificationTime", "length", "content").where(keep)
    return kept.select(below.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def documents(files: DataFrame, save: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """source_files with a dense id by path; a path is there once.

    Paths are range-partitioned and numbered within each part; only the parts' sizes meet in one task. The parts are
    written first, so that a part that is read again has the same rows.
    """
    save = save or scratch_save(files.sparkSession)
    once = files.dropDuplicates(["path"])
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = save(once.repartitionByRange(n, "path").withColumn("part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    return parts.withColumn("n", number).join(F.broadcast(before), "part").withColumn("doc_id", F.col("before") + F.col("n")).drop("part", "before", "n")


def read_text(spark: SparkSession, path: str) -> str:
    """A whole file in the first encoding that fits; '' if none does."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    for name in ENCODINGS if row else ():
        try:
            return bytes(row.content).decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return ""


def grammar_file(spark: SparkSession, path: str, **options) -> tuple[str, Grammar]:
    text = read_text(spark, path)
    return text, compile_grammar(text, **options)


def messages(spark: SparkSession, grammar: Grammar, root: str = "") -> DataFrame:
    """msg_index, text: a grammar's messages; one that begins with # names a file below root."""
    rows = []
    for i, text in enumerate(grammar.messages):
        name = text.strip()
        rows.append((i, read_text(spark, f"{root}/{name[1:].strip()}") if name.startswith("#") and "\n" not in name else text))
    return spark.createDataFrame(rows, "msg_index int, text string")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, col: str = "value") -> None:
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_index(docs: DataFrame, chunked: DataFrame, postings: DataFrame, path: str) -> None:
    """Drop and rebuild: documents, chunks and postings as tables."""
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    chunked.write.mode("overwrite").parquet(f"{path}/chunks")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
