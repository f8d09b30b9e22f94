"""Counts of the scanner, gathered by the tasks that scan: how often each terminal was tried, and how often it matched.

The counts are observed metrics of the scan itself: whatever action first runs the returned frame fills them, without
a job or a pass of its own, and a repeated task does not count twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .lexedges import Terminals, lex_places


def observed_places(df: DataFrame, ids: list[str], text_col: str, terminals: Terminals, name: str = "scanner") -> tuple[DataFrame, Observation]:
    """lex_places, and what its first action observes. Each place tries each terminal; a match behind trivia at a text's
    start counts at its own place."""
    seen = Observation(name)
    here = lambda i: F.size(F.filter("edges", lambda e: (e["t"] == i) & (e["start"] == F.col("at"))))
    sums = [F.coalesce(F.sum(here(i)), F.lit(0)).cast("long").alias(f"m{i}") for i in terminals.number.values()]
    return lex_places(df, ids, text_col, terminals).observe(seen, F.count(F.lit(1)).alias("places"), *sums), seen


def report(spark: SparkSession, seen: Observation, terminals: Terminals) -> DataFrame:
    """terminal, calls, matches of each terminal; waits for the observed frame's first action."""
    found = seen.get
    rows = [(n.strip('"'), found["places"], found[f"m{i}"]) for n, i in terminals.number.items() if i]
    return spark.createDataFrame(rows, "terminal string, calls long, matches long")
