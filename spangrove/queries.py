"""Queries over the driver's tables, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import corpus, search
from .operators import spans as sp
from .operators.alike import form, with_found
from .operators.parse import commits, diagnostics, forest_edges, forest_nodes, image, metrics, parse, parse_distinct, parse_forms, summary, token_ranges, tree_nodes
from .operators.parse import spans as spans_of
from .plans.grammar import compile_grammar

ARITHMETIC = r"""
space : /\s+/ .
number - /[0-9]+/ .
@left E = E "+" T | T .
@left T = T "*" F | F .
F = "(" E ")" | number .
"""
AMBIGUOUS = r"""
space : /\s+/ .
number - /[0-9]+/ .
@left E = E "+" E | E "*" E | number .
"""
TURN = r"""
space : /[ \t\r\n]+/ .
word - /[a-z]+/ .
S = word { word | "," } "." .
"""
DOUBLING = 'S = "b" | S S .'


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.length("text").cast("long").alias("chars"))


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = search.chunks(_table(spark, sf, "documents"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), F.md5("text").alias("text_md5"))


_COVER = "[A-Za-z]+|[0-9]+|[ \\t\\n\\r]+|[^A-Za-z0-9 \\t\\n\\r]"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, pos, token, start, stop over every turn, by lengths of the tokens that cover it."""
    t = _table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(_COVER), F.lit(0))).alias("pos", "token"))
    w = Window.partitionBy("conv_id", "turn").orderBy("pos")
    stop = F.sum(F.length("token")).over(w)
    return t.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "token", (stop - F.length("token")).alias("start"), stop.alias("stop"))


_TOKENS_SQL = f"""
t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{_COVER}')) AS token, generate_subscripts(regexp_extract_all(text, '{_COVER}'), 1) - 1 AS pos FROM conversations),
tokens AS (SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, token,
  CAST(sum(length(token)) OVER w - length(token) AS BIGINT) AS start, CAST(sum(length(token)) OVER w AS BIGINT) AS stop
  FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))
"""


def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf)


def boundary_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """For each visible token that is not its turn's first: is there space, or a line break, before it?"""
    t = _tokens(spark, sf)
    before = F.lag("token").over(Window.partitionBy("conv_id", "turn").orderBy("pos"))
    blank = F.coalesce(before.rlike("^[ \\t\\n\\r]+$"), F.lit(False))
    return t.withColumn("space", blank).withColumn("line", F.coalesce(blank & before.rlike("[\\n\\r]"), F.lit(False))).where("pos > 0 and token not rlike '^[ \\\\t\\\\n\\\\r]+$'").select("conv_id", "turn", "pos", "space", "line")


def munch_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Where a literal stands that no longer word of the class hides: an anti-join on the place."""
    t = _tokens(spark, sf)
    literals = F.array(*(F.lit(x) for x in ("the", "in", "of", "th")))
    found = t.select("conv_id", "turn", "start", "stop", "token", F.explode(literals).alias("literal")).where(F.col("token").startswith(F.col("literal")))
    longer = t.where("token rlike '^[a-z]+$'").select("conv_id", "turn", "start", F.col("stop").alias("class_stop"))
    ends = found.withColumn("end", F.col("start") + F.length("literal"))
    kept = ends.join(longer, ["conv_id", "turn", "start"], "left").where("class_stop is null or class_stop <= end")
    return kept.select("conv_id", "turn", "start", "literal")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    p = search.postings(_table(spark, sf, "documents"), "doc_id")
    return p.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.element_at("positions", 1).cast("long").alias("first_at"))


_QUERY = "the of NOT worthless"


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    best = search.search(search.postings(d, "doc_id"), search.lengths(d, "doc_id"), _QUERY, ["doc_id"])
    return best.select("doc_id", F.round("score", 6).alias("score"))


def fts_three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that hold both words, with their documents' source."""
    d = _table(spark, sf, "documents")
    c = search.chunks(d)
    p = search.postings(c, "doc_id", "chunk_index").where(F.col("term").isin("that", "with")).groupBy("doc_id", "chunk_index").agg(F.sum("tf").alias("tf"), F.count("*").alias("n")).where("n = 2")
    out = p.join(c.select("doc_id", "chunk_index", "start_offset"), ["doc_id", "chunk_index"]).join(d.select("doc_id", "source"), "doc_id")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_offset").cast("long").alias("start_offset"), "source", F.col("tf").cast("long").alias("tf"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("l_linenumber") % 2
    k = i + F.col("l_partkey") % 5
    return _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("msg"), (F.col("l_suppkey") % 3).alias("slot"), i.cast("long").alias("i"), k.cast("long").alias("k"), (k + F.col("l_quantity").cast("long") % 7).cast("long").alias("j")).distinct()


_SPANS_SQL = """
s AS (SELECT DISTINCT l_orderkey AS msg, l_suppkey % 3 AS slot, CAST(l_linenumber % 2 AS BIGINT) AS i, CAST(l_linenumber % 2 + l_partkey % 5 AS BIGINT) AS k,
  CAST(l_linenumber % 2 + l_partkey % 5 + CAST(l_quantity AS BIGINT) % 7 AS BIGINT) AS j FROM lineitem)
"""


def longest_extent(spark: SparkSession, sf: str) -> DataFrame:
    return sp.extent(_spans(spark, sf), ["msg"], True)


def shortest_extent(spark: SparkSession, sf: str) -> DataFrame:
    return sp.extent(_spans(spark, sf), ["msg"], False)


def left_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return sp.pivot(_spans(spark, sf), ["msg"], True)


def right_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return sp.pivot(_spans(spark, sf), ["msg"], False)


def prefer_same_span(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf)
    return sp.prefer(s.where("slot <> 0"), s.where("slot = 0"), ["msg"])


def call_return_join(spark: SparkSession, sf: str) -> DataFrame:
    li, o = _table(spark, sf, "lineitem"), _table(spark, sf, "orders")
    returns = li.select((F.col("l_orderkey") % 97).alias("x"), F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).alias("slot"), F.col("l_linenumber").cast("long").alias("i"))
    pops = o.select((F.col("o_orderkey") % 97).alias("x"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") + F.col("o_custkey") % 9).alias("j"))
    return sp.call_return(returns, pops)


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, text: as many b as each part's name has characters but for blanks."""
    return _table(spark, sf, "part").select("p_partkey", F.repeat(F.lit("b"), F.length(F.replace("p_name", F.lit(" "), F.lit("")))).alias("text"))


def catalan_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of S S in S = "b" | S S over n letters, for each part: i < k < j."""
    m = _letters(spark, sf)
    g = compile_grammar(DOUBLING)
    second = g.rules["S"].alternatives[1].elements[1].number
    return spans_of(parse(m, DOUBLING), "p_partkey").where(F.col("slot") == second).select("p_partkey", *(F.col(c).cast("long").alias(c) for c in "ikj"))


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def _expressions(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem")
    q, p, n = (F.col(c).cast("long").cast("string") for c in ("l_quantity", "l_partkey", "l_linenumber"))
    good = F.concat(q, F.lit(" + "), n, F.lit(" * ("), p, F.lit("+"), q, F.lit(")"))
    bad = F.concat(q, F.lit(" + * "), p)
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, bad).otherwise(good).alias("text"))


def parse_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: every line item's expression through the kernel."""
    p = parse_distinct(_expressions(spark, sf), ARITHMETIC, keep=())
    return p.select("l_orderkey", "l_linenumber", F.col("parse.accepted").alias("accepted"), F.col("parse.source_len").cast("long").alias("source_len"))


def parse_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Whether disambiguation dropped spans, for each distinct expression; rejected ones have none."""
    e = _expressions(spark, sf).select(F.regexp_replace("text", "[()]", "").alias("text")).distinct()
    return metrics(parse(e, AMBIGUOUS, resolve=True, keep=(), spread=True), "text").select("text", "exact", (F.col("pruned") > 0).alias("pruned"))


def parse_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Which lines of all turns are sentences of small words, commas and one full stop at the end."""
    lines = _table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    p = parse_distinct(lines, TURN, keep=())
    return p.select("conv_id", "turn", F.col("line").cast("long").alias("line"), F.col("parse.accepted").alias("accepted"))


def residual_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of what stays ambiguous, with the expressions as labels."""
    e = _expressions(spark, sf).select(F.concat("text", F.lit(" + 1 * 2 * 3")).alias("text"))
    loose = ARITHMETIC.replace("@left ", "").replace('E "+" T', 'E "+" E').replace('T "*" F', 'T "*" T')
    found = diagnostics(parse_forms(e, loose, keep=("diagnostics",)), "form")
    many = e.distinct().groupBy(form("text", compile_grammar(loose)).alias("form")).agg(F.count("*").alias("n"))
    return corpus.harvest_counts(found, many, "form").select("count", "node", "kind", "signature")


def signature_harvest(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events").select(F.col("event_id").alias("msg_index"), F.col("event_type").alias("node"), F.lit("ambiguous pivot").alias("message"), F.concat(F.lit("body="), (F.col("user_id") % 5).cast("string")).alias("signature"))
    labels = _table(spark, sf, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("msg_index"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("label"))
    return corpus.harvest(e, labels).select(F.col("count").cast("long").alias("count"), "node", "kind", "signature", "example_tests")


def forest_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges of the shared forests of the doubling grammar, for each part's letters."""
    letters = _letters(spark, sf)
    p = parse(letters.where("text is not null").select("text").distinct(), DOUBLING, keep=("forest",), spread=True)  # equal texts have one forest
    n = forest_nodes(p, "text").groupBy("text").agg(F.sum((F.col("kind") == "symbol").cast("long")).alias("symbols"))
    e = forest_edges(p, "text").groupBy("text").agg(F.count("*").alias("edges"))
    rows = letters.where("p_partkey is not null").join(n.join(e, "text"), "text")
    return rows.groupBy("p_partkey").agg(F.sum("symbols").alias("symbols"), F.sum("edges").alias("edges"))


def token_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each distinct expression, of rejected ones those that were committed."""
    e = _expressions(spark, sf).select("text").distinct()
    return commits(parse(e, ARITHMETIC, keep=("commits",), spread=True), "text").groupBy("text").agg(F.count("*").alias("tokens"), F.max("end").cast("long").alias("last_end"))


def performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _expressions(spark, sf).select((F.col("l_linenumber") % 3 == 0).alias("broken"), "text").distinct()
    return summary(parse(e, ARITHMETIC, keep=(), spread=True), "broken").select("broken", "runs", "accepted")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def section_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the nearest line before it, or itself, that is in capitals."""
    marked = _lines(spark, sf).withColumn("mark", F.when(F.col("text").rlike("^[A-Z][A-Z !?.,]+$"), F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("doc_id", F.col("line").cast("long").alias("line"), F.last("mark", True).over(w).cast("long").alias("section"))


def indent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Indents and dedents of lines whose column is the line's length modulo 5; empty lines do not count."""
    column = F.when(F.length("text") > 0, F.length("text") % 5)
    d = _lines(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", column.alias("c")))), lambda x: x["c"]).alias("columns"))
    return d.select("doc_id", F.array_join(tx.indent_events(F.col("columns")), "").alias("events"))


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    text = F.col("text")
    at = F.length(text)
    whole: Column = tx.whitespace_visible(tx.escapes_added(tx.html(text)))
    return d.select("doc_id", tx.line_position(text, at).alias("position"), tx.column_of(text, at).cast("long").alias("column_at"), F.md5(whole).alias("shown_md5"))


def label_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Names, titles, CSV fields, labels and epsilons made of each part's columns."""
    p = _table(spark, sf, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit("HTTPServer_x"), F.col("p_size").cast("string"), F.lit("Of THE \"Line\"")).alias("x"))
    symbol = F.when(F.col("p_partkey") % 3 == 0, "ε").when(F.col("p_partkey") % 3 == 1, "ԑ").otherwise("e")
    return p.select("p_partkey", tx.kebab(F.col("x")).alias("kebab"), tx.title_case(F.col("x")).alias("title"), tx.csv_field(F.col("x")).alias("field"), tx.graphviz_html(F.concat(F.lit("<"), F.col("x"), F.lit("&\n"))).alias("label"), tx.is_epsilon(symbol).alias("epsilon"), tx.stripped(F.lit("literal"), F.concat(F.lit('"'), F.col("x"), F.lit('"'))).alias("inner"))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """q, n: the distinct pairs of a quantity and a line number."""
    return _table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n")).distinct()


_SPACED = r"space : /\s+/ . number - /[0-9]+/ . "
#: Name, grammar, message from q and n.
PREDICATES = [
    ("lookbehind", _SPACED + r'day - /[0-9]+\./ . <+<("at") S = ("at" | "on") day .', lambda q, n: F.concat(F.when(n % 2 == 0, "at ").otherwise("on "), q, F.lit("."))),
    ("no_lookbehind", _SPACED + r'day - /[0-9]+\./ . <-<("at") S = ("at" | "on") day .', lambda q, n: F.concat(F.when(n % 2 == 0, "at ").otherwise("on "), q, F.lit("."))),
    ("exclusion", _SPACED + r'word - /[a-z]+/ . S = { w | "end" "!" } . w = word ---("end") .', lambda q, n: F.concat(F.repeat(F.lit("so "), (n % 3).cast("int")), F.when(q % 2 == 0, "end").otherwise("endless"))),
    ("predict", _SPACED + r'word - /[a-z]+/ . S = key ( "=" | ":" ) number . key = word >+>("=") .', lambda q, n: F.concat(F.lit("ab "), F.when(n % 2 == 0, "= ").otherwise(": "), q)),
    ("negative", _SPACED + r'word - /[a-z]+/ . S = key ( "=" | ":" ) number . key = word >->("=") .', lambda q, n: F.concat(F.lit("ab "), F.when(n % 2 == 0, "= ").otherwise(": "), q)),
    ("gap", _SPACED + r'S = number <s> "%" .', lambda q, n: F.concat(q, F.repeat(F.lit(" "), (n % 3).cast("int")), F.lit("%"))),
    ("no_gap", _SPACED + r'S = number >s< "%" .', lambda q, n: F.concat(q, F.repeat(F.lit(" "), (n % 3).cast("int")), F.lit("%"))),
    ("line_gap", _SPACED + r'S = number <n> "%" .', lambda q, n: F.concat(q, F.when(n % 2 == 0, "\n").otherwise(" "), F.lit("%"))),
    ("split", _SPACED + r'@splitBefore(">") close - />+/ . S = number | "<" S close .', lambda q, n: F.concat(F.repeat(F.lit("<"), (n % 4).cast("int")), q, F.repeat(F.lit(">"), (q % 4).cast("int")))),
    ("longest_word", _SPACED + r'@lexicalClass word - /[a-z]+/ . S = "in" number .', lambda q, n: F.concat(F.when(n % 2 == 0, "in ").otherwise("inn "), q)),
    ("trivia_rule", r'nested =: "(" { /[^()]/ | nested } ")" . number - /[0-9]+/ . S = number .', lambda q, n: F.concat(F.repeat(F.lit("("), (n % 3).cast("int")), F.lit("x"), F.repeat(F.lit(")"), (q % 3).cast("int")), q)),
    ("lexical_rule", _SPACED + r'pair =| number "-" number . S = pair pair .', lambda q, n: F.concat(q, F.when(n % 2 == 0, "-").otherwise(" - "), n, F.lit(" 3-4"))),
    ("layout", r'space : /\s+/ . word - /[a-z]+/ . S = word >>| word |<< word .', lambda q, n: F.concat(F.lit("a\n"), F.repeat(F.lit(" "), (n % 3).cast("int")), F.lit("b\n"), F.repeat(F.lit(" "), (q % 3).cast("int")), F.lit("c"))),
]


def terminal_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of grammars that look at what stands before, after and between tokens."""
    out, numbers = None, _numbers(spark, sf)
    for name, grammar, message in PREDICATES:
        texts = numbers.select(message(F.col("q"), F.col("n")).alias("text")).distinct()
        got = parse(texts, grammar, keep=()).select(F.lit(name).alias("predicate"), "text", F.col("parse.accepted").alias("accepted"))
        out = got if out is None else out.unionByName(got)
    return out


def furthest_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Where rejected expressions stop, and what could have stood there."""
    e = _expressions(spark, sf).select("text").distinct()
    p = parse(e, ARITHMETIC, keep=(), spread=True).where(~F.col("parse.accepted"))
    return p.select("text", F.col("parse.furthest").cast("long").alias("furthest"), F.array_join("parse.expected", " ").alias("expected"))


def terminal_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of each distinct expression without what was skipped between them."""
    e = _expressions(spark, sf).select("text")
    found = parse_forms(e, ARITHMETIC, keep=("commits",)).select("form", token_ranges().alias("ranges"))
    return with_found(e.distinct(), compile_grammar(ARITHMETIC), found).select("text", image("text", "ranges"))


def all_trees(spark: SparkSession, sf: str) -> DataFrame:
    """How many trees the doubling grammar has over as many letters as regions have characters, ten at most by the limit,
    and that each is another one."""
    m = _table(spark, sf, "region").select("r_regionkey", F.repeat(F.lit("b"), F.length("r_name")).alias("text"))
    p = parse(m, DOUBLING, keep=("trees",), trees=10)
    return p.select("r_regionkey", F.size("parse.trees").cast("long").alias("trees"), F.size(F.array_distinct("parse.trees")).cast("long").alias("distinct_trees"))


def single_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the one tree of each nation's name under a right-recursive rule: a leaf and a rule for each letter."""
    m = _table(spark, sf, "nation").select("n_nationkey", F.regexp_replace(F.upper("n_name"), "[^A-Z]", "").alias("text"))
    t = tree_nodes(parse(m, 'letter - /[A-Z]/ . S = letter | letter S .', keep=("tree",)), "n_nationkey")
    return t.groupBy("n_nationkey").agg(F.count("*").alias("nodes"), F.sum((F.col("name") == "letter").cast("long")).alias("leaves"), F.max("end").cast("long").alias("last_end"))


def avoided_option(spark: SparkSession, sf: str) -> DataFrame:
    """An option that is avoided: of two readings of 'n n' the one without it stays, and no choice is left."""
    texts = _numbers(spark, sf).select(F.concat_ws(" ", "q", "n").alias("text")).distinct()
    p = parse(texts, _SPACED + "S = [ @avoid number ] rest . rest = number | number number .", resolve=True, keep=("diagnostics",))
    return p.select("text", F.col("parse.exact").alias("exact"), (F.col("parse.pruned") > 0).alias("pruned"), F.size("parse.diagnostics").cast("long").alias("left"))


def parse_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the kernel on the doubling grammar that have closed forms: tokens, matches and needs."""
    return metrics(parse(_letters(spark, sf), DOUBLING, keep=()), "p_partkey").select("p_partkey", F.col("matches").cast("long").alias("matches"), F.col("tokens").cast("long").alias("tokens"), F.col("source_len").cast("long").alias("source_len"))


def _matching(spark: SparkSession, sf: str, query: str) -> DataFrame:
    return search.matching(search.postings(_table(spark, sf, "documents"), "doc_id"), query, ["doc_id"])


def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, '"of the"')


def search_or(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, "worthless OR (que AND par)")


def search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _matching(spark, sf, "ent* NOT que")


def ranked_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best chunks with their documents' paths."""
    d = _table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    h = search.hits(d, search.chunks(d), "the of NOT worthless")
    return h.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"))


def text_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Line positions and columns with tab stops at each quarter of every document, its end included."""
    d = _table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*(F.lit(q).cast("long") for q in range(1, 5)))).alias("quarter"))
    at = F.floor(F.length("text") * F.col("quarter") / 4).cast("int")
    return d.select("doc_id", "quarter", tx.line_position(F.col("text"), at).alias("position"), tx.column_of(F.col("text"), at).cast("long").alias("column_at"))


def relational_twin(spark: SparkSession, sf: str) -> DataFrame:
    """S = "b" | S S by joins alone, over the letters of each part."""
    from .sources.scratch import scratch_save

    tokens = _letters(spark, sf).select(F.col("p_partkey").alias("msg"), F.posexplode(F.split("text", "")).alias("i", "sym")).select("msg", "sym", F.col("i").cast("long").alias("i"), (F.col("i") + 1).cast("long").alias("j"))
    binary, unary = _rows(spark, [("S", "S", "S")], ["sym", "left", "right"]), _rows(spark, [("S", "b")], ["sym", "child"])
    return sp.derive(tokens, binary, unary, scratch_save(spark)).where("sym = 'S'").select("msg", "i", "j")


_CHUNKS_SQL = """
c AS (SELECT doc_id, start_offset, least(start_offset + 1400, n) AS end_offset, trim(substring(text, start_offset + 1, 1400), ' ' || chr(10) || chr(9) || chr(13)) AS piece
  FROM (SELECT doc_id, text, length(text) AS n, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 1400) / 1150.0) AS BIGINT), 0) * 1150, 1150)) AS start_offset FROM documents WHERE length(text) > 0)),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_offset) - 1 AS BIGINT) AS chunk_index, start_offset, end_offset, piece FROM c WHERE length(piece) > 0)
"""
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _window(order: str, by: str, fn: str, value: str) -> str:
    return f"WITH {_SPANS_SQL} SELECT msg, slot, i, k, j FROM (SELECT *, {fn}({value}) OVER (PARTITION BY msg, slot, {by}) AS best FROM s) WHERE {value} = best"


_PREDICATES_SQL = """
WITH m AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)
SELECT DISTINCT 'lookbehind' AS predicate, concat(CASE WHEN n % 2 = 0 THEN 'at ' ELSE 'on ' END, q, '.') AS text, n % 2 = 0 AS accepted FROM m
UNION ALL SELECT DISTINCT 'no_lookbehind', concat(CASE WHEN n % 2 = 0 THEN 'at ' ELSE 'on ' END, q, '.'), n % 2 <> 0 FROM m
UNION ALL SELECT DISTINCT 'exclusion', concat(repeat('so ', n % 3), CASE WHEN q % 2 = 0 THEN 'end' ELSE 'endless' END), q % 2 <> 0 FROM m
UNION ALL SELECT DISTINCT 'predict', concat('ab ', CASE WHEN n % 2 = 0 THEN '= ' ELSE ': ' END, q), n % 2 = 0 FROM m
UNION ALL SELECT DISTINCT 'negative', concat('ab ', CASE WHEN n % 2 = 0 THEN '= ' ELSE ': ' END, q), n % 2 <> 0 FROM m
UNION ALL SELECT DISTINCT 'gap', concat(q, repeat(' ', n % 3), '%'), n % 3 > 0 FROM m
UNION ALL SELECT DISTINCT 'no_gap', concat(q, repeat(' ', n % 3), '%'), n % 3 = 0 FROM m
UNION ALL SELECT DISTINCT 'line_gap', concat(q, CASE WHEN n % 2 = 0 THEN chr(10) ELSE ' ' END, '%'), n % 2 = 0 FROM m
UNION ALL SELECT DISTINCT 'split', concat(repeat('<', n % 4), q, repeat('>', q % 4)), CASE WHEN n % 4 = 0 THEN q % 4 = 0 ELSE q % 4 >= n % 4 END FROM m
UNION ALL SELECT DISTINCT 'longest_word', concat(CASE WHEN n % 2 = 0 THEN 'in ' ELSE 'inn ' END, q), n % 2 = 0 FROM m
UNION ALL SELECT DISTINCT 'trivia_rule', concat(repeat('(', n % 3), 'x', repeat(')', q % 3), q), false FROM m WHERE n % 3 = 0 OR n % 3 <> q % 3
UNION ALL SELECT DISTINCT 'trivia_rule', concat(repeat('(', n % 3), 'x', repeat(')', q % 3), q), true FROM m WHERE n % 3 > 0 AND n % 3 = q % 3
UNION ALL SELECT DISTINCT 'lexical_rule', concat(q, CASE WHEN n % 2 = 0 THEN '-' ELSE ' - ' END, n, ' 3-4'), n % 2 = 0 FROM m
UNION ALL SELECT DISTINCT 'layout', concat('a', chr(10), repeat(' ', n % 3), 'b', chr(10), repeat(' ', q % 3), 'c'), q % 3 < n % 3 FROM m
"""

ORACLE_SQL: dict[str, str] = {
    "terminal_predicates": _PREDICATES_SQL,
    "furthest_mismatch": """SELECT DISTINCT concat(q, ' + * ', p) AS text, CAST(length(q) AS BIGINT) + 1 AS furthest, '"*" "+"' AS expected
        FROM (SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, l_linenumber AS n FROM lineitem) WHERE n % 3 = 0""",
    "terminal_texts": """SELECT DISTINCT CASE WHEN n % 3 = 0 THEN concat(q, ' + * ', p) ELSE concat(q, ' + ', n, ' * (', p, '+', q, ')') END AS text, CASE WHEN n % 3 = 0 THEN q ELSE concat(q, '+', n, '*(', p, '+', q, ')') END AS image
        FROM (SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, l_linenumber AS n FROM lineitem)""",
    "all_trees": """SELECT r_regionkey, CAST(least(10, factorial(2 * k) / (factorial(k) * factorial(k + 1))) AS BIGINT) AS trees, CAST(least(10, factorial(2 * k) / (factorial(k) * factorial(k + 1))) AS BIGINT) AS distinct_trees
        FROM (SELECT r_regionkey, CAST(length(r_name) - 1 AS INTEGER) AS k FROM region)""",
    "single_tree": """SELECT n_nationkey, CAST(2 * n AS BIGINT) AS nodes, CAST(n AS BIGINT) AS leaves, CAST(n AS BIGINT) AS last_end FROM (SELECT n_nationkey, length(regexp_replace(upper(n_name), '[^A-Z]', '', 'g')) AS n FROM nation)""",
    "avoided_option": """SELECT DISTINCT concat(CAST(l_quantity AS BIGINT), ' ', l_linenumber) AS text, true AS exact, true AS pruned, CAST(0 AS BIGINT) AS "left" FROM lineitem""",
    "parse_counters": """SELECT p_partkey, CAST(1 AS BIGINT) AS matches, n AS tokens, n AS source_len FROM (SELECT p_partkey, length(replace(p_name, ' ', '')) AS n FROM part)""",
    "search_phrase": f"""SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS.format("text")}, ' ') || ' ', ' of the ')""",
    "search_or": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents) SELECT doc_id FROM d WHERE list_contains(w, 'worthless') OR (list_contains(w, 'que') AND list_contains(w, 'par'))""",
    "search_prefix": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents) SELECT doc_id FROM d WHERE contains(' ' || array_to_string(w, ' '), ' ent') AND NOT list_contains(w, 'que')""",
    "ranked_hits": f"""WITH {_CHUNKS_SQL}, d AS (SELECT doc_id, chunk_index, {_WORDS.format("piece")} AS words FROM chunks), w AS (SELECT doc_id, chunk_index, unnest(words) AS term FROM d),
        p AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM w WHERE term IN ('the', 'of', 'worthless') GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len(words)) AS a FROM d),
        s AS (SELECT p.doc_id, p.chunk_index, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / a))) AS b,
          bool_or(p.term = 'the') AND bool_or(p.term = 'of') AND NOT bool_or(p.term = 'worthless') AS ok FROM p JOIN f USING (term) JOIN d USING (doc_id, chunk_index), n GROUP BY p.doc_id, p.chunk_index)
        SELECT concat(source, '/', doc_id) AS path, chunk_index, round(-b, 6) AS score FROM s JOIN documents USING (doc_id) WHERE ok ORDER BY -b, doc_id, chunk_index LIMIT 8""",
    "label_functions": """WITH p AS (SELECT p_partkey, concat(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' '), 'HTTPServer_x', p_size, 'Of THE "Line"') AS x FROM part)
        SELECT p_partkey, translate(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1-\\2', 'g')), '_ ', '--') AS kebab,
        array_to_string(list_transform(list_filter(string_split(lower(x), ' '), lambda w: w <> ''), lambda w, i: CASE WHEN i > 1 AND w IN ('and', 'or', 'of', 'the', 'a', 'an', 'to', 'in', 'for', 'with', 'on') THEN w ELSE upper(left(w, 1)) || substring(w, 2) END), ' ') AS title,
        concat('"', replace(x, '"', '""'), '"') AS field, concat('&lt;', x, '&amp;<br/>') AS label, p_partkey % 3 < 2 AS epsilon, x AS inner FROM p""",
    "residual_ambiguity": """SELECT CAST(count(DISTINCT concat(q, '/', l_linenumber, '/', l_partkey)) AS BIGINT) AS count, node, 'ambiguous pivot' AS kind, signature FROM (SELECT CAST(l_quantity AS BIGINT) AS q, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber % 3 <> 0),
        (VALUES ('E', 'body=[E "+" E]'), ('T', 'body=[T "*" T]')) v(node, signature) GROUP BY node, signature""",
    "forest_tables": """SELECT p_partkey, CAST(n * (n + 1) // 2 AS BIGINT) AS symbols, CAST(2 * n + (n - 1) * n * (n + 1) // 2 + n * (n - 1) AS BIGINT) AS edges FROM (SELECT p_partkey, length(replace(p_name, ' ', '')) AS n FROM part)""",
    "indent_events": """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        c AS (SELECT doc_id, line, CASE WHEN length(t) > 0 THEN CAST(length(t) % 5 AS INTEGER) END AS c FROM l),
        s(doc_id, line, levels, events) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), [0], '' FROM c
          UNION ALL SELECT s.doc_id, CAST(c.line AS BIGINT), CASE WHEN c.c IS NULL THEN levels WHEN c.c > levels[-1] THEN list_append(levels, c.c) ELSE list_filter(levels, lambda x: x <= c.c) END,
            CASE WHEN c.c IS NULL THEN events WHEN c.c > levels[-1] THEN events || 'I' ELSE events || repeat('D', len(list_filter(levels, lambda x: x > c.c))) END
          FROM s JOIN c ON c.doc_id = s.doc_id AND c.line = s.line + 1)
        SELECT doc_id, arg_max(events || repeat('D', len(levels) - 1), line) AS events FROM s GROUP BY doc_id""",
    "scalar_functions": """WITH l AS (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|\n|\r') AS lines FROM documents), p AS (SELECT *, string_split(lines[-1], chr(9)) AS pieces FROM l)
        SELECT doc_id, concat('L', len(lines) - 1, 'P', length(lines[-1])) AS position, CAST(coalesce(list_sum(list_transform(pieces[:-2], lambda x: (length(x) // 8 + 1) * 8)), 0) + length(pieces[-1]) AS BIGINT) AS column_at,
        md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(39), chr(92) || chr(39)), ' ', '·')) AS shown_md5 FROM p""",
    "doc_fingerprint": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(length(text) AS BIGINT) AS chars FROM documents",
    "chunk_documents": f"WITH {_CHUNKS_SQL} SELECT doc_id, chunk_index, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, md5(piece) AS text_md5 FROM chunks",
    "token_offsets": f"WITH {_TOKENS_SQL} SELECT conv_id, turn, pos, token, start, stop FROM tokens",
    "boundary_gaps": f"""WITH {_TOKENS_SQL}, g AS (SELECT conv_id, turn, pos, token, lag(token) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM tokens)
        SELECT conv_id, turn, pos, regexp_full_match(before, '[ \\t\\n\\r]+') AS space, regexp_full_match(before, '[ \\t\\n\\r]+') AND regexp_matches(before, '[\\n\\r]') AS line
        FROM g WHERE pos > 0 AND NOT regexp_full_match(token, '[ \\t\\n\\r]+')""",
    "munch_literals": f"""WITH {_TOKENS_SQL}, l AS (SELECT unnest(['the', 'in', 'of', 'th']) AS literal)
        SELECT conv_id, turn, start, literal FROM tokens, l WHERE starts_with(token, literal) AND NOT (regexp_full_match(token, '[a-z]+') AND length(token) > length(literal))""",
    "postings": f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS term, generate_subscripts({_WORDS.format("text")}, 1) - 1 AS pos FROM documents)
        SELECT doc_id, term, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first_at FROM w GROUP BY doc_id, term""",
    "bm25_topk": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents), w AS (SELECT doc_id, unnest(words) AS term FROM d),
        p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'of', 'worthless') GROUP BY doc_id, term),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len(words)) AS a FROM d),
        s AS (SELECT p.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / a))) AS b,
          bool_or(p.term = 'the') AND bool_or(p.term = 'of') AND NOT bool_or(p.term = 'worthless') AS ok FROM p JOIN f USING (term) JOIN d USING (doc_id), n GROUP BY p.doc_id)
        SELECT doc_id, round(-b, 6) AS score FROM s WHERE ok ORDER BY -b, doc_id LIMIT 8""",
    "fts_three_way_join": f"""WITH {_CHUNKS_SQL}, w AS (SELECT doc_id, chunk_index, start_offset, unnest({_WORDS.format("piece")}) AS term FROM chunks),
        p AS (SELECT doc_id, chunk_index, start_offset, count(*) AS tf FROM w WHERE term IN ('that', 'with') GROUP BY ALL HAVING count(DISTINCT term) = 2)
        SELECT doc_id, chunk_index, CAST(start_offset AS BIGINT) AS start_offset, source, CAST(tf AS BIGINT) AS tf FROM p JOIN documents USING (doc_id)""",
    "longest_extent": _window("", "i", "max", "j"),
    "shortest_extent": _window("", "i", "min", "j"),
    "left_pivot": _window("", "i, j", "max", "k"),
    "right_pivot": _window("", "i, j", "min", "k"),
    "prefer_same_span": f"WITH {_SPANS_SQL} SELECT msg, slot, i, k, j FROM s WHERE slot <> 0 AND NOT EXISTS (SELECT 1 FROM s p WHERE p.slot = 0 AND p.msg = s.msg AND p.i = s.i AND p.j = s.j)",
    "call_return_join": """SELECT DISTINCT l_suppkey % 5 AS slot, CAST(l_linenumber AS BIGINT) AS i, l_orderkey AS k, o_orderkey + o_custkey % 9 AS j
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_orderkey % 97 = o_orderkey % 97""",
    "catalan_spans": """SELECT p_partkey, i, k, j FROM (SELECT p_partkey, length(replace(p_name, ' ', '')) AS n FROM part), LATERAL (SELECT unnest(range(0, n + 1)) AS i), LATERAL (SELECT unnest(range(0, n + 1)) AS k), LATERAL (SELECT unnest(range(0, n + 1)) AS j)
        WHERE i < k AND k < j""",
    "parse_expressions": """SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AS accepted, CAST(length(CASE WHEN l_linenumber % 3 = 0 THEN concat(q, ' + * ', p) ELSE concat(q, ' + ', n, ' * (', p, '+', q, ')') END) AS BIGINT) AS source_len
        FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem)""",
    "parse_turns": """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations)
        SELECT conv_id, turn, CAST(line AS BIGINT) AS line, regexp_full_match(line_text, '[ \\t\\r]*[a-z]+([ \\t\\r]*,|[ \\t\\r]*[a-z]+)*[ \\t\\r]*\\.[ \\t\\r]*') AS accepted FROM l""",
    "signature_harvest": """WITH e AS (SELECT event_type AS node, concat('body=', user_id % 5) AS signature, CASE WHEN event_id % 2 = 0 THEN concat('t', event_id) ELSE concat('?', event_id) END AS label FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY node, signature ORDER BY label) AS r, count(*) OVER (PARTITION BY node, signature) AS n FROM (SELECT DISTINCT * FROM e))
        SELECT CAST(max(n) AS BIGINT) AS count, node, 'ambiguous pivot' AS kind, signature, string_agg(label, ',' ORDER BY label) AS example_tests FROM r WHERE r <= 4 GROUP BY node, signature""",
    "performance_summary": """SELECT broken, count(*) AS runs, CAST(sum(CASE WHEN broken THEN 0 ELSE 1 END) AS BIGINT) AS accepted FROM (SELECT DISTINCT l_linenumber % 3 = 0 AS broken, CASE WHEN l_linenumber % 3 = 0 THEN concat(q, ' + * ', p) ELSE concat(q, ' + ', n, ' * (', p, '+', q, ')') END AS text
        FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem)) GROUP BY broken""",
    "token_commits": """SELECT DISTINCT CASE WHEN broken THEN concat(q, ' + * ', p) ELSE good END AS text, CAST(CASE WHEN broken THEN 1 ELSE 9 END AS BIGINT) AS tokens, CAST(length(CASE WHEN broken THEN q ELSE good END) AS BIGINT) AS last_end
        FROM (SELECT *, concat(q, ' + ', n, ' * (', p, '+', q, ')') AS good FROM (SELECT l_linenumber % 3 = 0 AS broken, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem))""",
    "parse_ambiguous": """SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN concat(CAST(l_quantity AS BIGINT), ' + * ', l_partkey) ELSE concat(CAST(l_quantity AS BIGINT), ' + ', l_linenumber, ' * ', l_partkey, '+', CAST(l_quantity AS BIGINT)) END AS text,
        l_linenumber % 3 <> 0 AS exact, l_linenumber % 3 <> 0 AS pruned FROM lineitem""",
    "section_asof": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
        m AS (SELECT doc_id, line FROM l WHERE regexp_full_match(t, '[A-Z][A-Z !?.,]+'))
        SELECT l.doc_id, CAST(l.line AS BIGINT) AS line, CAST(m.line AS BIGINT) AS section FROM l ASOF LEFT JOIN m ON l.doc_id = m.doc_id AND l.line >= m.line""",
    "relational_twin": """SELECT p_partkey AS msg, i, j FROM (SELECT p_partkey, length(replace(p_name, ' ', '')) AS n FROM part), LATERAL (SELECT unnest(range(0, n + 1)) AS i), LATERAL (SELECT unnest(range(0, n + 1)) AS j) WHERE i < j""",
    "text_positions": """WITH d AS (SELECT doc_id, text, unnest([1, 2, 3, 4]) AS quarter FROM documents),
        l AS (SELECT *, regexp_split_to_array(left(text, length(text) * quarter // 4), '\r\n|\n|\r') AS lines FROM d), p AS (SELECT *, string_split(lines[-1], chr(9)) AS pieces FROM l)
        SELECT doc_id, CAST(quarter AS BIGINT) AS quarter, concat('L', len(lines) - 1, 'P', length(lines[-1])) AS position,
        CAST(coalesce(list_sum(list_transform(pieces[:-2], lambda x: (length(x) // 8 + 1) * 8)), 0) + length(pieces[-1]) AS BIGINT) AS column_at FROM p""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        doc_fingerprint, chunk_documents, token_offsets, boundary_gaps, munch_literals, postings, bm25_topk, fts_three_way_join, longest_extent, shortest_extent, left_pivot, right_pivot, prefer_same_span, call_return_join,
        catalan_spans, parse_expressions, parse_ambiguous, parse_turns, residual_ambiguity, signature_harvest, forest_tables, token_commits, performance_summary,
        section_asof, indent_events, scalar_functions, text_positions, relational_twin, label_functions, terminal_predicates, furthest_mismatch, terminal_texts, all_trees, single_tree, avoided_option, parse_counters,
        search_phrase, search_or, search_prefix, ranked_hits,
    )
    return {f.__name__: f for f in every}
