"""Shared forests, pruning, counts and trees as tables over spans (msg, slot, i, k, j).

Nodes are found or created by their names, which say all that makes them what they are:

    R:o:0:i:j  rule o over i..j            P:a:d:i:j  the first d elements of alternative a over i..j
    B:e:0:i:j  bracket e over i..j         I:e:0:i:j  one iteration of closure e       T:t:0:i:j  a token, or nothing

A packed edge (parent, left, right) is one way to make its parent: what comes before the last part, and that part. Spans
give the edges row by row, so no fixpoint is needed to build a forest. What follows needs them: which nodes end in
tokens (an AND over left and right, an OR over edges), which the root leads to, how many derivations a node has, and the
n-th of them. All of these are rounds of joins on (msg, node) that take the last round's nodes only; `save(df, name)`
writes a round to a folder that all executors share. The number of rounds is the height of the forests.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.forest import Choice, choices
from ..plans.grammar import Grammar, Rule
from . import spans as sp

Save = Callable[[DataFrame, str], DataFrame]
BIG = "decimal(38,0)"


def node(kind: Column | str, o: Column, d: Column, i: Column, j: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, *(x.cast("string") for x in (o, d, i, j)))


def parts(node: Column | str) -> list[Column]:
    """kind, o, d, i, j of a node's name."""
    x = F.split(node, ":")
    return [x[0], *(x[k].cast("int") for k in range(1, 5))]


def closure_ends(steps: DataFrame, save: Save, ids: list[str]) -> DataFrame:
    """ids, s, m: where chains of one or more adjoining intervals (ids, s, m) that begin at s can end: path doubling, so
    a chain of n takes log n rounds; cycles add nothing new and end them."""
    seen = save(steps.select(*ids, "s", "m").where("s < m").distinct(), "paths0")
    n = seen.count()
    for k in itertools.count(1):
        on = seen.select(*ids, F.col("s").alias("m"), F.col("m").alias("to"))
        longer = seen.join(on, [*ids, "m"]).select(*ids, "s", F.col("to").alias("m"))
        seen = save(seen.unionByName(longer).distinct(), f"paths{k}")
        n, before = seen.count(), n
        if n == before:
            return seen


def _slots(spark: SparkSession, g: Grammar) -> DataFrame:
    """A row for each element: sent by broadcast, as large as the grammar."""
    rows = []
    for a in g.alternatives:
        for d, e in enumerate(a.elements):
            kind = {"term": "T", "call": "R", "eps": "E", "gap": "E"}.get(e.kind, "B")
            of = g.rules[e.name].number if e.kind == "call" else e.number if e.bracket else g.symbols.get(e.name, -1)
            owner = a.owner
            top = "R" if isinstance(owner, Rule) else "I" if owner.closure else "B"
            rows.append((e.number, a.number, d, kind, of, d + 1 == len(a.elements), top, owner.number, e.kind in ("opt", "star"), e.closure))
    return F.broadcast(spark.createDataFrame(rows, "slot int, alt int, d int, kind string, of int, last boolean, top string, owner int, skips boolean, closure boolean"))


def packed(spans: DataFrame, g: Grammar, save: Save) -> DataFrame:
    """msg, parent, left (null where nothing is before), right, and the span (slot, i, k, j) that an edge comes from."""
    at = spans.join(_slots(spans.sparkSession, g), "slot")
    i, k, j, zero = F.col("i"), F.col("k"), F.col("j"), F.lit(0)
    right = F.when(F.col("kind") == "E", node("T", F.lit(-1), zero, k, j)).otherwise(node(F.col("kind"), F.col("of"), zero, k, j))
    left = F.when(F.col("d") > 0, node("P", F.col("alt"), F.col("d"), i, k))
    mine = ["slot", "i", "k", "j"]
    out = at.select("msg", node("P", F.col("alt"), F.col("d") + 1, i, j).alias("parent"), left.alias("left"), right.alias("right"), *mine)
    none = F.lit(None).cast("string").alias("left")
    blank = [F.lit(None).cast("int").alias(c) for c in mine]
    # Owners, where their own span says that they ended there.
    whole = spans.where("i = k").select("msg", F.col("slot").alias("owner"), "i", "j").distinct()
    bodies = at.where("last").select("msg", "owner", "top", "alt", "d", "i", "j").distinct().join(whole, ["msg", "owner", "i", "j"])
    body = node("P", F.col("alt"), F.col("d") + 1, i, j).alias("right")
    out = out.unionByName(bodies.select("msg", node(F.col("top"), F.col("owner"), zero, i, j).alias("parent"), none, body, *blank))
    left_out = at.where("skips and k = j").select("msg", "of", "k").distinct()
    out = out.unionByName(left_out.select("msg", node("B", F.col("of"), zero, k, k).alias("parent"), none, node("T", F.lit(-1), zero, k, k).alias("right"), *blank))
    if any(e.closure for e in g.elements):
        steps = bodies.where("top = 'I'").select("msg", F.col("owner").alias("e"), F.col("i").alias("s"), F.col("j").alias("m")).distinct()
        paths = closure_ends(steps, save, ["msg", "e"])
        e, s, m, to = (F.col(c) for c in ("e", "s", "m", "to"))
        single = steps.select("msg", node("B", e, zero, s, m).alias("parent"), none, node("I", e, zero, s, m).alias("right"), *blank)
        more = paths.join(steps.where("s < m").select("msg", "e", F.col("s").alias("m"), F.col("m").alias("to")), ["msg", "e", "m"])
        more = more.select("msg", node("B", e, zero, s, to).alias("parent"), node("B", e, zero, s, m).alias("left"), node("I", e, zero, m, to).alias("right"), *blank)
        out = out.unionByName(single).unionByName(more)
    return out.distinct()


def alive(edges: DataFrame, save: Save) -> DataFrame:
    """msg, node: nodes from which some choice of edges ends in tokens."""
    is_token = lambda c: F.coalesce(F.col(c).startswith("T:"), F.lit(c == "left"))
    todo = save(edges.select("msg", "parent", "left", "right").distinct().withColumn("l", is_token("left")).withColumn("r", is_token("right")), "alive_todo0")
    seen = None
    for k in itertools.count(1):
        new = todo.where("l and r").select("msg", F.col("parent").alias("node")).distinct()
        new = save(new if seen is None else new.join(seen, ["msg", "node"], "left_anti"), f"alive{k}")
        if new.isEmpty():
            return new if seen is None else seen
        seen = new if seen is None else seen.unionByName(new)
        known = new.withColumn("ok", F.lit(True))
        marked = todo.where("not (l and r)")
        for c, flag in (("left", "l"), ("right", "r")):
            marked = marked.join(known.withColumnRenamed("node", c), ["msg", c], "left").withColumn(flag, F.col(flag) | F.coalesce("ok", F.lit(False))).drop("ok")
        todo = save(marked.select("msg", "parent", "left", "right", "l", "r"), f"alive_todo{k}")


def reachable(edges: DataFrame, roots: DataFrame, save: Save) -> DataFrame:
    """msg, node: what the roots (msg, node) lead to."""
    down = edges.select("msg", F.col("parent").alias("node"), F.explode(F.array("left", "right")).alias("child")).where("child is not null").distinct()
    new = seen = save(roots.select("msg", "node").distinct(), "reached0")
    for k in itertools.count(1):
        step = new.join(down, ["msg", "node"]).select("msg", F.col("child").alias("node")).distinct()
        new = save(step.join(seen, ["msg", "node"], "left_anti"), f"reached{k}")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def roots_of(spans: DataFrame, g: Grammar, lengths: DataFrame) -> DataFrame:
    """msg, node: the root over the whole text, where it has one. lengths: msg, n."""
    whole = spans.where((F.col("slot") == g.root.number) & (F.col("i") == 0) & (F.col("k") == 0)).join(lengths, "msg").where("j = n")
    return whole.select("msg", node("R", F.col("slot"), F.lit(0), F.col("i"), F.col("j")).alias("node"))


def forest(spans: DataFrame, g: Grammar, lengths: DataFrame, save: Save) -> DataFrame:
    """The edges that whole derivations of the texts use."""
    edges = save(packed(spans, g, save), "packed")
    good = alive(edges, save)
    for c in ("left", "right"):
        ok = good.withColumnRenamed("node", c)
        edges = edges.where(F.col(c).isNull() | F.col(c).startswith("T:")).unionByName(edges.where(~F.col(c).startswith("T:")).join(ok, ["msg", c], "left_semi"))
    edges = save(edges, "alive_edges")
    kept = reachable(edges, roots_of(spans, g, lengths), save)
    return save(edges.join(kept.withColumnRenamed("node", "parent"), ["msg", "parent"], "left_semi"), "forest")


def prune(spans: DataFrame, g: Grammar, lengths: DataFrame, save: Save) -> DataFrame:
    """The spans that whole derivations use; none of a text that the root does not cover."""
    edges = forest(spans, g, lengths, save)
    used = edges.where("slot is not null").select("msg", "slot", "i", "k", "j")
    kind, o, _, i, j = parts("parent")
    owners = edges.where(F.substring("parent", 1, 1).isin("R", "B", "I")).select("msg", kind.alias("kind"), o.alias("slot"), i.alias("i"), i.alias("k"), j.alias("j")).distinct()
    closures = [e.number for e in g.elements if e.closure]
    owners = owners.where(~((F.col("kind") == "B") & F.col("slot").isin(*closures))) if closures else owners
    return used.unionByName(owners.drop("kind")).distinct().join(spans.distinct(), ["msg", "slot", "i", "k", "j"], "left_semi")


def resolve(spans: DataFrame, g: Grammar, lengths: DataFrame, save: Save, rules: list[Choice] | None = None) -> DataFrame:
    """Prune, apply the rules until nothing changes, prune again. Texts that the root does not cover keep their spans."""
    rules = choices(g) if rules is None else rules
    named = lambda tag: lambda df, name: save(df, f"{tag}_{name}")
    covered = save(roots_of(spans, g, lengths).select("msg").distinct(), "covered")
    rest = spans.join(covered, "msg", "left_anti")
    kept = save(prune(spans.join(covered, "msg", "left_semi"), g, lengths, named("first")), "kept0")
    n, changed = kept.count(), False
    for k in itertools.count(1):
        after = save(sp.apply(kept, rules, ["msg"]), f"kept{k}")
        m = after.count()
        if m == n:
            break
        kept, n, changed = after, m, True
    if changed:
        kept = prune(kept, g, lengths, named("second"))
    return rest.unionByName(kept)


def counts(edges: DataFrame, save: Save) -> DataFrame:
    """msg, node, n: how many derivations each node of a forest has, as a decimal; nodes on cycles have no number."""
    todo = edges.select("msg", "parent", "left", "right").distinct()
    one = lambda c: F.when(F.col(c).isNull() | F.col(c).startswith("T:"), F.lit(1).cast(BIG))
    todo = save(todo.withColumn("l", one("left")).withColumn("r", one("right")), "count_todo0")
    seen = None
    for k in itertools.count(1):
        ready = F.max((F.col("l").isNull() | F.col("r").isNull()).cast("int")) == 0
        new = save(todo.groupBy("msg", F.col("parent").alias("node")).agg(F.sum((F.col("l") * F.col("r")).cast(BIG)).cast(BIG).alias("n"), ready.alias("ready")).where("ready").drop("ready"), f"counted{k}")
        if new.isEmpty():
            return new if seen is None else seen
        seen = new if seen is None else seen.unionByName(new)
        marked = todo.join(new.select("msg", F.col("node").alias("parent")), ["msg", "parent"], "left_anti")
        for c, x in (("left", "l"), ("right", "r")):
            marked = marked.join(new.withColumnRenamed("node", c), ["msg", c], "left").withColumn(x, F.coalesce(x, "n")).drop("n")
        todo = save(marked.select("msg", "parent", "left", "right", "l", "r"), f"count_todo{k}")


def trees(edges: DataFrame, counted: DataFrame, roots: DataFrame, limit: int, save: Save) -> DataFrame:
    """msg, tree, path, node: the first `limit` derivations of the roots, by unranking.

    The edges of a node, in the order of their names, hold stretches of its derivations as long as the product of what
    their parts have; the n-th derivation lies in one of them and gives the left and the right part a number each. A path
    is the way from the root, l and r at each step.
    """
    from pyspark.sql import Window

    of = lambda c, x: counted.select("msg", F.col("node").alias(c), F.col("n").alias(x))
    one = F.lit(1).cast(BIG)
    rows = edges.select("msg", "parent", "left", "right").distinct().join(of("left", "l"), ["msg", "left"], "left").join(of("right", "r"), ["msg", "right"], "left")
    token = lambda c: F.col(c).isNull() | F.col(c).startswith("T:")
    rows = rows.withColumn("l", F.when(token("left"), one).otherwise(F.col("l"))).withColumn("r", F.when(token("right"), one).otherwise(F.col("r"))).where("l is not null and r is not null")
    size = (F.col("l") * F.col("r")).cast(BIG)
    w = Window.partitionBy("msg", "parent").orderBy(F.coalesce("left", F.lit("")), "right")
    ways = save(rows.withColumn("to", F.sum(size).over(w).cast(BIG)).withColumn("from", (F.col("to") - size).cast(BIG)).withColumnRenamed("parent", "node").drop("l"), "ways")
    first = roots.join(counted, ["msg", "node"]).withColumn("tree", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(limit)).cast("int") - 1)))
    new = save(first.select("msg", "tree", F.lit("").alias("path"), "node", F.col("tree").cast(BIG).alias("rank")), "trees0")
    out = new
    for k in itertools.count(1):
        met = new.join(ways, ["msg", "node"]).where("rank >= from and rank < to").withColumn("rank", (F.col("rank") - F.col("from")).cast(BIG))
        div = F.floor(F.col("rank") / F.col("r")).cast(BIG)
        rest = (F.col("rank") - div * F.col("r")).cast(BIG)
        both = F.array(F.struct(F.lit("l").alias("s"), F.col("left").alias("node"), div.alias("rank")), F.struct(F.lit("r").alias("s"), F.col("right").alias("node"), rest.alias("rank")))
        new = save(met.withColumn("x", F.explode(both)).where("x.node is not null").select("msg", "tree", F.concat("path", "x.s").alias("path"), F.col("x.node").alias("node"), F.col("x.rank").alias("rank")), f"trees{k}")
        if new.isEmpty():
            return out.drop("rank")
        out = out.unionByName(new)
