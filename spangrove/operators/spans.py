"""Disambiguation and reachability as relations over spans (slot, i, k, j), and parsing itself as joins.

Each rule is a window or an anti-join that keeps its partitioning on the message, so rules applied one after another
on one message id shuffle once.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.forest import Choice
from ..sources.scratch import free_name


def extent(spans: DataFrame, ids: list[str], longest: bool) -> DataFrame:
    """Per start, the spans with the greatest (least) end."""
    w = Window.partitionBy(*ids, "slot", "i")
    best = free_name(spans, "best")
    return spans.withColumn(best, (F.max if longest else F.min)("j").over(w)).where(F.col("j") == F.col(best)).drop(best)


def pivot(spans: DataFrame, ids: list[str], left: bool) -> DataFrame:
    """Per start and end, the spans with the greatest (left) or least (right) pivot."""
    w = Window.partitionBy(*ids, "slot", "i", "j")
    best = free_name(spans, "best")
    return spans.withColumn(best, (F.max if left else F.min)("k").over(w)).where(F.col("k") == F.col(best)).drop(best)


def prefer(others: DataFrame, preferred: DataFrame, ids: list[str]) -> DataFrame:
    """Spans without those that a preferred alternative covers too."""
    return others.join(preferred.select(*ids, "i", "j").distinct(), [*ids, "i", "j"], "left_anti")


def apply(spans: DataFrame, rules: list[Choice], ids: list[str]) -> DataFrame:
    """One round of the grammar's rules, in their order."""
    for c in rules:
        mine, rest = spans.where(F.col("slot") == c.number), spans.where(F.col("slot") != c.number)
        if c.kind == "prefer":
            kept = prefer(mine, spans.where(F.col("slot").isin(*c.preferred)), ids)
        elif c.kind in ("longest", "shortest"):
            kept = extent(mine, ids, c.kind == "longest")
        else:
            kept = pivot(mine, ids, c.kind == "left")
        spans = rest.unionByName(kept.select(*spans.columns))
    return spans


def call_return(returns: DataFrame, pops: DataFrame) -> DataFrame:
    """Where callers go on: returns (x, k, slot, i) meet pops (x, k, j)."""
    return returns.join(pops, ["x", "k"]).select("slot", "i", "k", "j").distinct()


def closure(edges: DataFrame, roots: DataFrame, save) -> DataFrame:
    """Nodes reachable from roots (node) over edges (src, dst): semi-naive, a round for each step.

    save(df, name) writes a round's rows to a folder that executors share and reads them back, which cuts lineage and
    survives lost executors.
    """
    seen = delta = save(roots.select("node").distinct(), "reach0")
    for k in itertools.count(1):
        step = delta.join(edges, delta["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        delta = save(step.join(seen, "node", "left_anti"), f"reach{k}")
        if delta.isEmpty():
            return seen
        seen = save(seen.unionByName(delta), f"seen{k}")


def derive(tokens: DataFrame, binary: DataFrame, unary: DataFrame, save) -> DataFrame:
    """All spans (msg, sym, i, j) of a grammar in binary form, as joins: parsing without the kernel.

    tokens: (msg, sym, i, j) as lexed. binary: (sym, left, right). unary: (sym, child). For small inputs: each round is
    a few joins.
    """
    seen = delta = save(tokens.select("msg", "sym", "i", "j").distinct(), "derive0")
    for k in itertools.count(1):
        up = delta.join(F.broadcast(unary), delta["sym"] == unary["child"]).select("msg", unary["sym"], "i", "j")
        out = up
        for here, there, a, b in ((delta, seen, "left", "right"), (seen, delta, "left", "right")):
            x = here.join(F.broadcast(binary.withColumnRenamed("sym", "up")), F.col("sym") == F.col(a)).select("msg", "up", F.col(b).alias("want"), F.col("i"), F.col("j").alias("mid"))
            y = there.select("msg", F.col("sym").alias("want"), F.col("i").alias("mid"), "j")
            out = out.unionByName(x.join(y, ["msg", "want", "mid"]).select("msg", F.col("up").alias("sym"), "i", "j"))
        delta = save(out.distinct().join(seen, ["msg", "sym", "i", "j"], "left_anti"), f"derive{k}")
        if delta.isEmpty():
            return seen
        seen = save(seen.unionByName(delta), f"seen{k}")
