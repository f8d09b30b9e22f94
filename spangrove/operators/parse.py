"""Grammar over a table of messages: one row in, one row out, all derivations nested in it.

The grammar is compiled on the driver and travels with the task; every message is parsed by itself, so partitions are
all the parallelism there is and nothing is shuffled before the spans are. Equal texts can be parsed once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.forest import Trees, choices, disambiguate, sppf
from ..plans.grammar import Grammar, compile_grammar
from ..plans.kernel import Kernel, Parse, TooLarge
from ..sources.scratch import free_name
from .alike import form

SPAN = "struct<slot: int, i: int, k: int, j: int>"
COMMIT = "struct<terminal: int, trivia_start: int, start: int, end: int, trivia_end: int>"
DIAGNOSTIC = "struct<node: string, message: string, start: int, end: int, candidates: int, signature: string>"
RESULT = f"""accepted boolean, exact boolean, matches int, source_len int, tokens int, descriptors long, duplicates long,
    suppressed long, clusters long, spans long, failed long, furthest int, expected array<string>, pruned long, too_large boolean,
    bsr array<{SPAN}>, commits array<{COMMIT}>, diagnostics array<{DIAGNOSTIC}>, trees array<string>,
    nodes array<struct<node: string, kind: string, label: string, start: int, end: int>>, edges array<struct<parent: string, child: string, place: int>>,
    tree array<struct<node: int, parent: int, place: int, name: string, start: int, end: int, image: string, ambiguous: boolean>>"""

_kernels: dict[tuple, Kernel] = {}


def kernel(text: str, builders: tuple = (), start: str = "", most_items: int = 5_000_000) -> Kernel:
    """The compiled kernel of this process."""
    key = text, builders, start, most_items
    if key not in _kernels:
        if len(_kernels) > 32:
            _kernels.clear()
        _kernels[key] = Kernel(compile_grammar(text, dict(builders), start), most_items)
    return _kernels[key]


NAMES = ("accepted", "exact", "matches", "tokens", "descriptors", "duplicates", "suppressed", "clusters", "spans", "failed", "furthest", "pruned")
#: What can be carried over from a text of the same shape.
CARRIED = frozenset(("bsr", "commits", "diagnostics"))
MOST_SHAPES = 4096
MOST_PLACES = 4096
_shapes: dict[tuple, tuple[dict, list[int]]] = {}


def outcome(k: Kernel, text: str | None, resolve: bool, keep: frozenset[str], trees: int) -> dict | None:
    """The result row of one message; None for null. What one text needs never fails the others."""
    if text is None:
        return None
    sys.setrecursionlimit(1_000_000_000)  # Python's own frames are on the heap
    try:
        if not k.shaped or not keep <= CARRIED or len(text) > MOST_PLACES:
            return parsed_outcome(k, text, resolve, keep, trees)
        shape, places, matches = k.shape(text)
        key = id(k), shape, resolve, keep
        if key not in _shapes:
            if len(_shapes) >= MOST_SHAPES:
                _shapes.clear()
            _shapes[key] = parsed_outcome(k, text, resolve, keep, trees), places
            return _shapes[key][0]
        return carried(k, *_shapes[key], text, places, matches)
    except (TooLarge, RecursionError, MemoryError):
        return dict.fromkeys(NAMES, 0) | {"source_len": len(text), "too_large": True, "accepted": None, "exact": None, "expected": None} | dict.fromkeys(("bsr", "commits", "diagnostics", "trees", "nodes", "edges", "tree"))


def carried(k: Kernel, row: dict, old: list[int], text: str, new: list[int], matches: dict) -> dict:
    """The result row of a text from that of another one of the same shape: places for places."""
    at = dict(zip(old, new, strict=True))
    out = row | {"source_len": len(text), "furthest": at[row["furthest"]]}
    if row["bsr"] is not None:
        out["bsr"] = [(n, at[i], at[x], at[j]) for n, i, x, j in row["bsr"]]
    if row["commits"] is not None:
        names = k.names
        out["commits"] = [(t, at[a], (m := matches[names[t], at[a]]).start, m.end, at[after]) for t, a, _, _, after in row["commits"]]
    if row["diagnostics"] is not None:
        out["diagnostics"] = [(n, m, at[s], at[e], c, sig) for n, m, s, e, c, sig in row["diagnostics"]]
    return out


def parsed_outcome(k: Kernel, text: str, resolve: bool, keep: frozenset[str], trees: int) -> dict | None:
    """The result row of one message."""
    out: dict = dict.fromkeys(NAMES, 0) | {"source_len": len(text), "too_large": False, "expected": None} | dict.fromkeys(("bsr", "commits", "diagnostics", "trees", "nodes", "edges", "tree"))
    p = k.parse(text)
    out |= {"accepted": p.accepted, "exact": p.exact, "matches": len(p.ends()), "tokens": len({c[2:4] for c in p.commits}), "descriptors": p.items, "duplicates": p.duplicates, "suppressed": p.suppressed, "clusters": p.needs, "failed": p.failed, "furthest": p.furthest, "expected": sorted(p.expected)}
    if resolve:
        out["pruned"] = disambiguate(p)
    out["spans"] = p.span_count()
    if "bsr" in keep:
        out["bsr"] = [(n, *span) for n in sorted(p.spans) for span in sorted(p.spans[n])]
    if "commits" in keep:
        out["commits"] = [(p.grammar.symbols[c[0]], *c[1:]) for c in sorted(p.commits)]
    if keep & {"diagnostics", "ast", "tree"}:
        t = Trees(p)
        tree = t.one()
        out["diagnostics"] = [(d.node, d.message, d.start, d.end, d.candidates, d.signature) for d in t.diagnostics]
        if "ast" in keep and tree:
            out["trees"] = [tree.dump()]
        if "tree" in keep and tree:
            out["tree"] = list(tree.rows())
    if "trees" in keep:
        out["trees"] = [x.dump() for x in Trees(p).every(trees)]
    if "forest" in keep:
        out["nodes"], out["edges"] = sppf(p)
    return out


def column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; lists of structs come as lists of tuples and are built from flat columns."""
    if all(v is None for v in values):
        return pa.nulls(len(values), kind)
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    ends, flat = [0], []
    for v in values:
        flat += v or ()
        ends.append(len(flat))
    fields = list(kind.value_type)
    parts = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    inner = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=pa.array([v is None for v in values]))


def structs(rows: list[dict | None], kind: pa.StructType) -> pa.StructArray:
    columns = [column([None if r is None else r[f.name] for r in rows], f.type) for f in kind]
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array([r is None for r in rows], pa.bool_()))


def parse(df: DataFrame, grammar: str, text_col: str = "text", resolve: bool = False, keep: tuple[str, ...] = ("bsr",), builders: dict[str, str] | None = None, start: str = "", trees: int = 10, most_items: int = 5_000_000, batch_rows: int = 500, spread: bool = False) -> DataFrame:
    """df with a column `parse`. keep: what of bsr, commits, diagnostics, ast (one tree as text), tree (the same as
    rows), trees (up to `trees` of all) and forest comes with it.

    A column `parse` that df has is replaced. A null text has a null parse. Texts in which the same terminals match in the
    same order are parsed once by each worker where nothing else decides (Kernel.shaped), and their places are mapped.
    A message of more than most_items items is reported as too_large, with null verdicts. spread deals the
    messages to all shuffle partitions first: after an aggregation they may be few bytes but are still much work.
    """
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = tuple(sorted((builders or {}).items()))
    compile_grammar(grammar, builders, start)  # errors are the driver's
    wanted = frozenset(keep)
    field = "parse"
    row = StructType.fromDDL(RESULT)
    df = df.drop("parse") if "parse" in [c.lower() for c in df.columns] and text_col.lower() != "parse" else df
    whole = StructType([*df.schema.fields]).add(field, row)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(row)
        k = kernel(grammar, held, start, most_items)
        for batch in (b.slice(i, batch_rows) for b in batches for i in range(0, b.num_rows, batch_rows)):
            found = [outcome(k, t, resolve, wanted, trees) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, structs(found, kind)], names=[*batch.schema.names, field])

    return df.mapInArrow(run, whole)


def parse_distinct(df: DataFrame, grammar: str, text_col: str = "text", **options) -> DataFrame:
    """As parse, but each distinct text is parsed once and the results are joined back by its hash. Spark takes the few
    columns that are read of the results for small however many texts there are, so they are never sent by broadcast."""
    df = df.drop("parse") if text_col.lower() != "parse" else df
    key = free_name(df, "text_hash")
    keyed = df.withColumn(key, F.sha2(F.col(text_col), 256))
    once = parse(keyed.where(F.col(text_col).isNotNull()).groupBy(key).agg(F.first(text_col).alias("text")), grammar, "text", spread=True, **options)
    return keyed.join(once.select(key, "parse").hint("merge"), key, "left").drop(key)


def spans(parsed: DataFrame, *ids: str) -> DataFrame:
    """ids, slot, i, k, j: the central relation."""
    return parsed.select(*ids, F.explode("parse.bsr").alias("s")).select(*ids, "s.slot", "s.i", "s.k", "s.j")


def commits(parsed: DataFrame, *ids: str) -> DataFrame:
    return parsed.select(*ids, F.explode("parse.commits").alias("c")).select(*ids, "c.*")


def diagnostics(parsed: DataFrame, *ids: str) -> DataFrame:
    return parsed.select(*ids, F.explode("parse.diagnostics").alias("d")).select(*ids, "d.*")


def forest_nodes(parsed: DataFrame, *ids: str) -> DataFrame:
    return parsed.select(*ids, F.explode("parse.nodes").alias("n")).select(*ids, "n.*")


def forest_edges(parsed: DataFrame, *ids: str) -> DataFrame:
    return parsed.select(*ids, F.explode("parse.edges").alias("e")).select(*ids, "e.*")


def tree_nodes(parsed: DataFrame, *ids: str) -> DataFrame:
    """One row for each node of the single tree: node, parent, place among its siblings, name, start, end, image."""
    return parsed.select(*ids, F.explode("parse.tree").alias("t")).select(*ids, "t.*")


def parse_forms(df: DataFrame, grammar: str, text_col: str = "text", keep: tuple[str, ...] = ("bsr",), builders: dict[str, str] | None = None, start: str = "", **options) -> DataFrame:
    """form, parse: the forms of the texts (`alike`), each parsed once. keep: what does not show the texts' characters."""
    if not CARRIED.issuperset(keep):
        raise ValueError(f"texts of one form differ in {', '.join(sorted(set(keep) - CARRIED))}")
    forms = df.select(form(text_col, compile_grammar(grammar, builders, start)).alias("form")).where("form is not null").distinct()
    return parse(forms, grammar, "form", keep=keep, builders=builders, start=start, spread=True, **options)


def token_ranges() -> Column:
    """Start and end of the tokens of a parse in order, without those within longer ones."""
    tokens = F.array_distinct(F.transform("parse.commits", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    longest = F.filter(tokens, lambda t: (t["end"] > t["start"]) & ~F.exists(tokens, lambda o: (o["start"] == t["start"]) & (o["end"] > t["end"])))
    return F.array_sort(longest)


def image(text_col: str, ranges: Column | str) -> Column:
    return F.array_join(F.transform(ranges, lambda t: F.col(text_col).substr(t["start"] + 1, t["end"] - t["start"])), "").alias("image")


def terminal_text(parsed: DataFrame, text_col: str, *ids: str) -> DataFrame:
    """ids, image: the tokens of each message in order, without what was skipped between them."""
    return parsed.select(*ids, image(text_col, token_ranges()))


def metrics(parsed: DataFrame, *ids: str) -> DataFrame:
    names = ["accepted", "exact", "matches", "source_len", "tokens", "descriptors", "duplicates", "suppressed", "clusters", "spans", "pruned", "furthest"]
    return parsed.select(*ids, *(F.col(f"parse.{n}").alias(n) for n in names))


def signature_lines(parsed: DataFrame, index_col: str) -> DataFrame:
    """SIG<tab>index<tab>node<tab>message<tab>signature."""
    d = diagnostics(parsed, index_col)
    return d.select(F.concat_ws("\t", F.lit("SIG"), F.col(index_col).cast("string"), "node", "message", "signature").alias("value"))


def summary(parsed: DataFrame, *by: str) -> DataFrame:
    """Totals and averages of runs; unknown: those without a verdict, too large or null."""
    m = metrics(parsed, *by)
    return m.groupBy(*by).agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.col("accepted").cast("long")), F.lit(0)).alias("accepted"), F.sum(F.col("accepted").isNull().cast("long")).alias("unknown"), F.sum("descriptors").alias("descriptors"), F.avg("descriptors").alias("avg_descriptors"), F.sum("spans").alias("spans"))


def verdicts(parsed: DataFrame, expected_col: str) -> DataFrame:
    """Counts by what was expected ('accept' or 'reject') and what came out ('unknown' for messages that are too large or null)."""
    got = F.when(F.col("parse.accepted"), "accept").when(~F.col("parse.accepted"), "reject").otherwise("unknown")
    residual = F.size(F.coalesce("parse.diagnostics", F.array())) > 0
    return parsed.groupBy(F.col(expected_col).alias("expected"), got.alias("got"), residual.alias("ambiguous")).count()


__all__ = ["Grammar", "Parse", "choices", "commits", "diagnostics", "forest_edges", "forest_nodes", "metrics", "parse", "parse_distinct", "parse_forms", "signature_lines", "spans", "summary", "verdicts"]
