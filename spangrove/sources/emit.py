"""Text renderings of grammars and forests: Graphviz, HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.forest import Tree
from ..plans.grammar import Grammar, ebnf

SHAPES = {"symbol": "box", "intermediate": "box,style=rounded", "packed": "point", "terminal": "plaintext", "epsilon": "plaintext"}


def dot_lines(nodes: DataFrame, edges: DataFrame, *ids: str) -> DataFrame:
    """ids, ord, value: a digraph for each forest, line by line, from node and edge tables."""
    shape = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in SHAPES.items()), F.lit("box"))
    label = F.replace(F.replace(F.concat_ws(" ", "label", F.concat_ws(",", F.col("start").cast("string"), F.col("end").cast("string"))), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    head = nodes.select(*ids).distinct().select(*ids, F.lit(0).alias("part"), F.lit("").alias("key"), F.lit("digraph {").alias("value"))
    body = nodes.select(*ids, F.lit(1).alias("part"), F.col("node").alias("key"), F.concat(F.lit('  "'), "node", F.lit('" [label="'), label, F.lit('",shape='), shape, F.lit("]")).alias("value"))
    arrows = edges.select(*ids, F.lit(2).alias("part"), F.concat_ws(">", "parent", F.col("place").cast("string"), "child").alias("key"), F.concat(F.lit('  "'), "parent", F.lit('" -> "'), "child", F.lit('"')).alias("value"))
    tail = head.select(*ids, F.lit(3).alias("part"), F.lit("").alias("key"), F.lit("}").alias("value"))
    return head.unionByName(body).unionByName(arrows).unionByName(tail).orderBy(*ids, "part", "key").select(*ids, "value")


def tree_dot(trees: list[Tree]) -> str:
    out = ["digraph {"]
    for t, tree in enumerate(trees):
        for number, parent, _, name, start, end, image, ambiguous in tree.rows():
            label = f"{name} [{start}..{end}]" + (f" {image}" if image else "")
            label = label.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
            out.append(f'  t{t}n{number} [label="{label}"{",color=red" if ambiguous else ""}]')
            if parent is not None:
                out.append(f"  t{t}n{parent} -> t{t}n{number}")
    return "\n".join([*out, "}"])


def grammar_dot(g: Grammar) -> str:
    """Rules and which rule uses which."""
    from ..plans.analysis import rule_references

    names = {n: f"r{i}" for i, n in enumerate(sorted(g.rules))}
    out = ["digraph {", *(f'  {v} [label="{n}"]' for n, v in names.items())]
    return "\n".join([*out, *(f"  {names[a]} -> {names[b]}" for a, b in rule_references(g)), "}"])


def grammar_html(g: Grammar, title: str = "Summary of the Grammar") -> str:
    """A page with a box for each rule, uses linked to definitions."""
    boxes = []
    for name in sorted(g.rules, key=lambda n: (n != g.start, n)):
        words = [f'<a href="#{escape(w)}">{escape(w)}</a>' if w in g.rules and i else escape(w) for i, w in enumerate(ebnf(g.rules[name]).split(" "))]
        boxes.append(f'<p id="{escape(name)}"><code>{" ".join(words)}</code></p>')
    terminals = "".join(f"<li><code>{escape(t.name)}</code> {escape(t.source)}{' (skipped)' if t.skip else ''}</li>" for t in g.terminals.values())
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1>{''.join(boxes)}<ul>{terminals}</ul>"
