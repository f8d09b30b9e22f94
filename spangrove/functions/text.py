"""Text functions as Spark columns. Positions are code points from 0."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.grammar import ESCAPES

#: Code points that stand for an empty production.
EPSILONS = list("εϵԐԑ𝛆𝛜𝜀𝜖𝜺𝝐𝝴𝞊𝞮𝟄")
#: Words that stay small in titles unless they come first.
SMALL_WORDS = ["and", "or", "of", "the", "a", "an", "to", "in", "for", "with", "on"]


def prefix(text: Column, at: Column) -> Column:
    return text.substr(F.lit(1), at)


def line_position(text: Column, at: Column) -> Column:
    """L<line>P<column>, both from 0; \\r\\n, \\n and \\r each break a line."""
    lines = F.split(prefix(text, at), "\r\n|\n|\r", -1)
    return F.concat(F.lit("L"), (F.size(lines) - 1).cast("string"), F.lit("P"), F.length(F.element_at(lines, -1)).cast("string"))


def column_of(text: Column, at: Column, tab: int = 8) -> Column:
    """The column with tab stops."""
    last = F.element_at(F.split(prefix(text, at), "\r\n|\n|\r", -1), -1)
    pieces = F.split(last, "\t", -1)
    # Every piece but the last ends at the next stop.
    whole = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(0), lambda acc, p: acc + (F.floor(F.length(p) / tab).cast("int") + 1) * tab)
    return whole + F.length(F.element_at(pieces, -1))


def escapes_removed(x: Column) -> Column:
    for a, b in ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escapes_added(x: Column) -> Column:
    for a, b in [*reversed(ESCAPES), ("\\'", "'")]:
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def graphviz_html(x: Column) -> Column:
    """For labels: entities, breaks for line feeds, and escapes resolved."""
    return escapes_removed(F.replace(html(x), F.lit("\n"), F.lit("<br/>")))


def harvest_unescape(x: Column) -> Column:
    for a, b in (('\\"', '"'), ("\\\\", "\\"), ("\\u{feff}", "\ufeff"), ("\\t", "\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def whitespace_visible(x: Column) -> Column:
    return F.translate(x, " \t\n", "·→↵")


def is_epsilon(x: Column) -> Column:
    return x.isin(*EPSILONS)


#: What Unicode calls white space.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends; only the ends are read."""
    return F.btrim(x, F.lit(BLANKS))


def kebab(x: Column) -> Column:
    """Small words joined by hyphens, cut before a capital after a small letter or digit, or before the last of several."""
    cut = F.regexp_replace(x, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "-")
    return F.translate(F.lower(cut), "_ ", "--")


def title_case(x: Column) -> Column:
    words = F.filter(F.split(F.lower(x), " "), lambda w: w != "")
    big = lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(big(w))), " ")


def identifier(x: Column) -> Column:
    """A name for any text: letters and digits stay, other characters give their Unicode names in capitals' style, the
    first letter is small, and a digit gets an underscore before it."""
    return F.pandas_udf(_identifiers, "string")(x)


def _identifiers(x: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out = "".join(c if c.isalpha() or c.isnumeric() else name_of(c) for c in text)
        return "_empty" if not out else "_" + out if out[0].isnumeric() else out[0].lower() + out[1:]

    def name_of(c: str) -> str:
        name = unicodedata.name(c, "")
        return "".join(w.capitalize() for w in name.replace("-", " ").split(" ")) if name else f"U{ord(c):X}"

    return x.map(one)


def stripped(kind: Column, image: Column) -> Column:
    """A token's text without the marks of its kind."""
    inner = image.substr(F.lit(2), F.length(image) - 2)
    return F.when(kind.isin("literal", "regex", "action"), inner).when(kind == "pragma", image.substr(F.lit(2), F.length(image))).when(kind == "message", image.substr(F.lit(4), F.length(image))).otherwise(image)


def csv_field(x: Column) -> Column:
    """RFC 4180."""
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike('[",\n\r]'), quoted).otherwise(x)


def snippet(text: Column, at: Column, most: int = 30) -> Column:
    """What stands at a place, up to white space; at least one character."""
    rest = text.substr(at + 1, F.lit(most))
    word = F.regexp_extract(rest, r"^(?U)\S+", 0)
    return F.when(word == "", rest.substr(1, 1)).otherwise(word)


def indent_events(lines: Column) -> Column:
    """I and D of each line's column (an array of ints, null for lines that do not count), by a fold over the lines."""
    start = F.struct(F.array(F.lit(0)).alias("levels"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        top = F.element_at(acc["levels"], -1)
        deeper = F.struct(F.concat(acc["levels"], F.array(c)).alias("levels"), F.concat(acc["out"], F.array(F.lit("I"))).alias("out"))
        kept = F.filter(acc["levels"], lambda x: x <= c)
        kept = F.when(F.size(kept) == 0, F.array(F.lit(0))).otherwise(kept)
        closed = F.size(acc["levels"]) - F.size(kept)
        shallower = F.struct(kept.alias("levels"), F.concat(acc["out"], F.array_repeat(F.lit("D"), closed)).alias("out"))
        return F.when(c.isNull(), acc).when(c > top, deeper).otherwise(shallower)

    return F.aggregate(lines, start, step, lambda acc: F.concat(acc["out"], F.array_repeat(F.lit("D"), F.size(acc["levels"]) - 1)))
