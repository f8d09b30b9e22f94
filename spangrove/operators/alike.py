"""Texts that differ in nothing that a terminal tells apart.

Where all terminals are literals and (repeated) classes of characters, a letter, digit or blank that no literal holds says
no more than which classes it is in. With one of them for each set of classes a text becomes its form: the same terminals match
at the same places of both, so texts of one form have one parse, place for place, and each form is parsed once.
"""

from __future__ import annotations

import string

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grammar import Grammar
from ..sources.scratch import free_name, scratch_save
from .lexruns import _class

#: Characters that patterns of Java and of Python put into the same classes.
PLAIN = string.digits + string.ascii_letters + " \t"
#: Bytes of what is sent to all tasks rather than dealt with the texts.
SENT = 1 << 23


def same_characters(g: Grammar) -> dict[str, str]:
    """Characters that another one stands for in forms. None where a grammar has terminals or layout of another kind."""
    if g.layout or any(r.trivia for r in g.rules.values()) or any(t.lexical_rule for t in g.terminals.values()):
        return {}
    kinds = [_class(t) for t in g.terminals.values() if not t.literal]
    if not all(k and not any(x in k[0] for x in ("&&", "--", "||", "~~")) for k in kinds):
        return {}
    fixed = set("".join((t.source if t.literal else "") + (t.split_before or "") for t in g.terminals.values()))
    classes, first, out = [regex.compile(k) for k, _ in kinds], {}, {}
    for c in PLAIN:
        if c not in fixed:
            one = first.setdefault(tuple(bool(x.fullmatch(c)) for x in classes), c)
            if one != c:
                out[c] = one
    return out


def form(text: Column | str, g: Grammar) -> Column:
    """The form of a text; itself where none of its characters is like another."""
    same = same_characters(g)
    return F.translate(text, "".join(same), "".join(same.values())) if same else F.col(text) if isinstance(text, str) else text


def with_found(df: DataFrame, g: Grammar, found: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the columns of found (form, ...; a row for each form), null where there is none. What is found is sent to the
    tasks while it is small, whatever Spark takes it for; a larger one is merged."""
    held = scratch_save(df.sparkSession)(found, "found")
    size = held.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    key = free_name(df, "form")
    return df.withColumn(key, form(text_col, g)).join((F.broadcast(held) if size <= SENT else held.hint("merge")).withColumnRenamed("form", key), key, "left").drop(key)
