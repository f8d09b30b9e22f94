"""The parse kernel over a stream of messages. It keeps no state, so late or repeated messages need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parse import parse


def parse_stream(stream: DataFrame, grammar: str, text_col: str = "text", **options) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return parse(stream, grammar, text_col, **options)


def verdicts_by_window(stream: DataFrame, grammar: str, time_col: str, text_col: str = "text", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """How many messages of each window of time are accepted; windows close once the watermark passes them."""
    parsed = parse(stream, grammar, text_col, keep=()).withWatermark(time_col, late)
    return parsed.groupBy(F.window(time_col, width), F.col("parse.accepted").alias("accepted")).count()
