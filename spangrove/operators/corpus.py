"""Test corpora out of source files: calls with a string argument, and the harvest of ambiguity signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = "assertParse("
_PART = re.compile(r'(?P<pounds>#*)(?P<quote>"""|")|//[^\n]*|/\*.*?\*/|[()]', re.S)


def string_end(text: str, at: int, pounds: int, quote: str) -> int:
    """After the literal whose quotes open at `at` (its #s before it); -1 if it is open."""
    close = quote + "#" * pounds
    escape = "\\" + "#" * pounds
    at += len(quote)
    while at < len(text):
        if text.startswith(close, at):
            return at + len(close)
        if text.startswith(escape, at):
            at += len(escape) + 1
        elif text[at] == "\n" and quote == '"':
            return -1
        else:
            at += 1
    return -1


def closing(text: str, at: int) -> int:
    """The bracket that closes the one at `at`, outside strings and comments; -1 for none."""
    depth, here = 0, at
    while True:
        m = _PART.search(text, here)
        if not m:
            return -1
        here = m.end()
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if not depth:
                return m.start()
        elif m["quote"]:
            here = string_end(text, m.start("quote"), len(m["pounds"]), m["quote"])
            if here < 0:
                return -1


def first_string(body: str) -> tuple[str, str] | None:
    """The literal as written and what follows, if the first argument is one."""
    body = body.lstrip()
    m = re.match(r'(#*)("""|")', body)
    if not m:
        return None
    end = string_end(body, m.start(2), len(m[1]), m[2])
    return (body[:end], body[end:]) if end > 0 else None


def calls(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, literal, rest of the arguments) of each call with a literal."""
    at = text.find(CALL)
    while at >= 0:
        end = closing(text, at + len(CALL) - 1)
        if end < 0:
            at = text.find(CALL, at + 1)
            continue
        found = first_string(text[at + len(CALL) : end])
        if found:
            yield at, *found
        at = text.find(CALL, end + 1)


def content(literal: str) -> str:
    """What a literal says: without quotes, and a block without its indentation."""
    pounds = len(literal) - len(literal.lstrip("#"))
    if not literal.startswith('"""', pounds):
        return literal[pounds + 1 : len(literal) - 1 - pounds]
    inside = literal[pounds + 3 : literal.rindex('"""')].removeprefix("\n")
    lines = inside.split("\n")
    margin = len(lines[-1]) - len(lines[-1].lstrip())
    if not lines[-1].strip():
        lines.pop()
    return "\n".join(x[margin:] if len(x) >= margin else x for x in lines)


def strip_markers(x: Column) -> Column:
    """Without keycap digits and info signs."""
    return F.regexp_replace(F.regexp_replace(x, "[0-9]\ufe0f\u20e3", ""), "\u2139\ufe0f", "")


def snippets(files: DataFrame, path_col: str = "path", text_col: str = "text", version: str = "") -> DataFrame:
    """label, source, origin, literal, underscored, expected ('accept', or 'reject' where diagnostics are asked for).

    Labels count the calls of each function of a file, valid and invalid ones apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                heads = [(m.start(), m[1]) for m in re.finditer(r"func\s+(test\w+)\s*\(", text)]
                for at, literal, rest in calls(text):
                    name = next((n for s, n in reversed(heads) if s < at), "unknown")
                    rows.append((path, at, name, literal, content(literal), "reject" if re.search(r"diagnostics ?:", rest) else "accept"))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "at", "func", "literal", "source", "expected"])

    found = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, "path string, at long, func string, literal string, source string, expected string")
    number = F.row_number().over(Window.partitionBy("path", "func", "expected").orderBy("at"))
    base = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return found.select(
        F.concat("func", F.lit("#"), number.cast("string")).alias("label"), strip_markers(F.col("source")).alias("source"), F.concat(base, F.lit("."), "func").alias("origin"), strip_markers(F.col("literal")).alias("literal"),
        F.col("literal").rlike(r"@_\w").alias("underscored"), F.lit(version).alias("syntax_version"), "expected",
    )


_ENTRY = re.compile(r"\b\w*Snippet\(")
_LABEL = re.compile(r'label:\s*"([^"]+)"')
_SOURCE = re.compile(r'source:\s*(?=#*")')


def labelled(text: str) -> Iterator[tuple[str, str, bool]]:
    """(label, source, disabled) of each entry of a corpus file; an entry ends where the next begins."""
    begins = [m.start() for m in _ENTRY.finditer(text)]
    for a, b in zip(begins, [*begins[1:], len(text)], strict=False):
        part = text[a:b]
        label, source = _LABEL.search(part), _SOURCE.search(part)
        found = first_string(part[source.end() :]) if label and source else None
        if found:
            yield label[1], content(found[0]).strip("\n"), "disabledReason:" in found[1].split("),")[0]


def corpus_entries(files: DataFrame, text_col: str = "text") -> DataFrame:
    """label, source, disabled of all entries of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for t in batch.column(0).to_pylist() for x in labelled(t or "")]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["label", "source", "disabled"])

    return files.select(text_col).mapInArrow(run, "label string, source string, disabled boolean")


def harvest(diagnostics: DataFrame, labels: DataFrame | None = None, index_col: str = "msg_index", examples: int = 4) -> DataFrame:
    """count, node, kind, signature, example_tests, most first. labels: (index, label); an index without one is ?n."""
    d = diagnostics.select(F.col(index_col).alias("n"), "node", F.col("message").alias("kind"), "signature")
    unknown = F.concat(F.lit("?"), F.col("n").cast("string"))
    d = d.join(labels.select(F.col(index_col).alias("n"), "label"), "n", "left").withColumn("label", F.coalesce("label", unknown)) if labels is not None else d.withColumn("label", unknown)
    # Distinct labels first, so that a signature of very many tests is reduced before its group meets.
    once = d.select("node", "kind", "signature", "label").distinct()
    rank = F.row_number().over(Window.partitionBy("node", "kind", "signature").orderBy("label"))
    few = once.withColumn("r", rank).where(F.col("r") <= examples).groupBy("node", "kind", "signature").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("example_tests"))
    out = once.groupBy("node", "kind", "signature").agg(F.count("*").alias("count")).join(few, ["node", "kind", "signature"])
    return out.select("count", "node", "kind", "signature", "example_tests").orderBy(F.desc("count"), "node", "kind", "signature")


def harvest_counts(diagnostics: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """count, node, kind, signature, most first, of diagnostics that stand for more than one test: many has (key, n)."""
    once = diagnostics.select(key, "node", F.col("message").alias("kind"), "signature").distinct()
    return once.join(many, key).groupBy("node", "kind", "signature").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "node", "kind", "signature")


def log_counts(lines: DataFrame, categories: dict[str, str], col: str = "value") -> DataFrame:
    """How many lines hold each category's text; a line counts for the first that fits."""
    kind = F.coalesce(*(F.when(F.col(col).contains(text), name) for name, text in categories.items()))
    return lines.select(kind.alias("category")).where("category is not null").groupBy("category").count()
