"""Rounds of a fixpoint written to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; of this machine only where that is not set and the session runs within
    one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spangrove-")
    return f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it ends, rather than when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with it; the setting for that is put back behind it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def scratch_save(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """save(df, name) writes a table in a folder of its own below spark.checkpoint.dir and reads it back. The shuffle files
    of a round go with its write."""
    root = scratch_root(spark)

    def save(df: DataFrame, name: str) -> DataFrame:
        with cleaned(spark):
            df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return save


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
