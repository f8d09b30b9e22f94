"""Matching brackets of whole texts, strings left out: prefix depths and windows, no loop over characters.

One pattern reads strings and brackets from left to right, so brackets inside strings are never seen, and the lengths
of what lies between give the places. With +1 for an opening and -1 for a closing bracket, the depth is the running sum
less its own running minimum where that is below zero, since a closing bracket too many takes nothing away. An opening
bracket and the next closing one on its depth are a pair: they stand next to each other among the brackets of their depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strings end at their quote or at the end of the line; a backslash keeps the character behind it.
STRINGS = r""""(?:[^"\\\n]|\\.)*+"?"""
OPENERS, CLOSERS = "([{", ")]}"


def marks(df: DataFrame, ids: list[str], text_col: str, strings: str = STRINGS) -> DataFrame:
    """ids, at, mark: brackets outside strings. A null text has none."""
    pattern, text = rf"(?s)(?:{strings})|[()\[\]{{}}]", F.coalesce(F.col(text_col), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = df.select(*ids, F.posexplode(F.arrays_zip(found.alias("mark"), gaps.alias("gap"))).alias("nth", "x")).where("x.mark is not null")
    w = Window.partitionBy(*ids).orderBy("nth")
    size = F.length("x.mark")
    return rows.select(*ids, "nth", F.col("x.mark").alias("mark"), (F.sum(F.col("x.gap") + size).over(w) - size).alias("at")).where(F.length("mark") == 1).where(F.col("mark") != '"').drop("nth")


def pairs(df: DataFrame, ids: list[str], text_col: str, strings: str = STRINGS) -> DataFrame:
    """ids, start, end, depth (from 1), alike: each opening bracket with the one that closes it, null where none does;
    alike says whether both are of one kind."""
    w = Window.partitionBy(*ids).orderBy("at")
    opens = F.col("mark").isin(*OPENERS)
    step = F.when(opens, 1).otherwise(-1)
    summed = marks(df, ids, text_col, strings).withColumn("opens", opens).withColumn("sum", F.sum(step).over(w))
    low = F.least(F.min("sum").over(w), F.lit(0))
    depth = summed.withColumn("depth", F.col("sum") - low)
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    level = depth.withColumn("level", F.when(F.col("opens"), F.col("depth")).otherwise(before)).where("level > 0")
    mine = Window.partitionBy(*ids, "level").orderBy("at")
    met = level.withColumn("end", F.lead("at").over(mine)).withColumn("closer", F.lead("mark").over(mine)).where("opens")
    alike = F.translate("mark", OPENERS, CLOSERS) == F.col("closer")
    return met.select(*ids, F.col("at").alias("start"), "end", F.col("level").alias("depth"), alike.alias("alike"))
