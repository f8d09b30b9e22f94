"""Queries of the operators that work as tables throughout: tokens, filters, charts, forests, brackets and the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import forest_tables as ft
from .operators import lexedges as le
from .operators import lexruns as lr
from .operators.alike import form, with_found
from .operators.brackets import pairs
from .operators.chart import chart, shape
from .operators.grammar_tables import Grammars
from .operators.index_store import Index
from .operators.search import Query
from .operators.telemetry import observed_places, report
from .plans.grammar import compile_grammar
from .queries import _CHUNKS_SQL, _WORDS
from .sources.scratch import scratch_root, scratch_save

#: Words, numbers and marks of running text; small words are also literals, hidden where a longer word stands.
PROSE = r"""
blank : /[ \t\r]+/ .
@lexicalClass word - /[A-Za-zÀ-ÿ]+/ .
number - /[0-9]+/ .
comma - /,/ . <+<(word)
@splitBefore(".") dots - /\.+/ .
S = word | number | comma | dots | "the" | "de" | "in" .
"""


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str, documents: bool = True) -> DataFrame:
    """source, id, turn, line, text: the lines of all turns, and of all documents."""
    split = F.posexplode(F.split("text", "\n")).alias("line", "text")
    turns = _table(spark, sf, "conversations").select(F.lit("turn").alias("source"), F.col("conv_id").alias("id"), "turn", split)
    docs = _table(spark, sf, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), split)
    return turns.unionByName(docs) if documents else turns


_IDS = ["source", "id", "turn", "line"]


def _named(terminals: le.Terminals, t: str = "t"):
    out = F.lit("end")
    for n, i in terminals.number.items():
        if i:
            out = F.when(F.col(t) == i, F.lit(n.strip('"'))).otherwise(out)
    return out


#: The sum of a run's starts.
_STARTS = "cast(start as long) * places + cast(places as long) * (places - 1) div 2"


def lex_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of all terminals at all places of all lines, summed for each line and terminal."""
    terminals = le.Terminals(compile_grammar(PROSE))
    runs = lr.lex_runs(_lines(spark, sf), _IDS, "text", terminals).where(f"t <> {le.END}")
    many = lambda c: F.sum(F.col(c).cast("long") * F.col("places"))
    sums = runs.groupBy("source", "id", "turn", "t").agg(F.sum("places").alias("n"), F.sum(F.expr(_STARTS)).alias("starts"), many("end").alias("ends"), many("after").alias("afters"))
    return sums.select("source", "id", "turn", _named(terminals).alias("terminal"), "n", "starts", "ends", "afters")


def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of all turns' lines after each filter, each applied to what the one before has left."""
    terminals = le.Terminals(compile_grammar(PROSE))
    number = terminals.number
    ids = ["id", "turn", "line"]
    word, small = number["word"], [number[f'"{x}"'] for x in ("the", "de", "in")]
    filters = [
        F.lit(True),
        lr.behind(terminals),
        lr.exclude({word: small}),
        lr.ahead({word: [number["comma"], number["dots"], word]}, True),
        lr.ahead({word: [number["comma"]]}, False),
    ]
    kept = [f"kept{k}" for k in range(6)]
    turns = _table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    # Turns that share their ids, or lack one, meet others or none in the SQL; those are taken through windows.
    odd = turns.groupBy("id", "turn").count().where("count > 1 or id is null or turn is null").select(F.col("id").alias("id_"), F.col("turn").alias("turn_"))
    same = F.col("id").eqNullSafe(F.col("id_")) & F.col("turn").eqNullSafe(F.col("turn_"))
    every = []
    for how, shared in (("left_anti", False), ("left_semi", True)):
        lines = turns.join(odd, same, how).select("id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
        rows = lr.lex_sets(lines, ids, "text", terminals, shared).where(f"t <> {le.END}")
        for k, f in enumerate(filters):
            rows = rows.withColumn(kept[k], f & F.col(kept[k - 1]) if k else f)
        rows = rows.withColumn(kept[5], F.col(kept[4]) & lr.one_end(ids, kept[4]) if shared else F.col(kept[4]))
        every.append(rows.select("id", "turn", "start", "places", "t", "end", *kept))
    # A row stands for as many candidates as it has places, which the filters took alike.
    many = lambda k: F.coalesce(F.sum(F.when(F.col(k), F.col("places").cast("long"))), F.lit(0).cast("long"))
    left = lambda x: F.sum(F.when(F.col(kept[5]), x))
    counts = [many(k).alias(f"after_{i}") for i, k in enumerate(kept)]
    sums = every[0].unionByName(every[1]).groupBy("id", "turn", "t").agg(*counts, left(F.expr(_STARTS)).alias("starts"), left(F.col("end").cast("long") * F.col("places")).alias("ends"))
    return sums.select("id", "turn", _named(terminals).alias("terminal"), *(f"after_{i}" for i in range(6)), "starts", "ends")


def chart_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct expression of the line items parsed by joins: its verdict, and the spans of the rule of factors."""
    from .queries import ARITHMETIC, _expressions

    texts, g = _expressions(spark, sf).select("text").where("text is not null"), compile_grammar(ARITHMETIC)
    # Each shape is parsed once, on one of its forms; its spans go back to all of these by the order of their places, and
    # from a form to its texts as they are.
    forms = texts.select(form("text", g).alias("text")).distinct()
    shaped = scratch_save(spark)(forms.select("text", shape(F.col("text"), le.Terminals(g)).alias("x")).select("text", "x.*"), "shapes")
    one = scratch_save(spark)(shaped.groupBy("shape").agg(F.min(F.struct("text", "places")).alias("x")).select("shape", "x.*"), "texts")
    c = chart(one, "shape", "text", ARITHMETIC)
    factor = c.slots.g.rules["F"].number
    spans = c.spans().where(F.col("slot") == factor).join(one.select(F.col("shape").alias("msg"), "places"), "msg")
    rank = lambda p: F.array_position("places", F.col(p)).cast("int")
    found = spans.groupBy("msg").agg(F.collect_list(F.struct(rank("i").alias("i"), rank("j").alias("j"))).alias("spans")).join(c.verdicts(), "msg")
    at = F.transform("spans", lambda s: F.struct(*(F.element_at("places", s[p]).cast("long").alias(p) for p in "ij")))
    found = shaped.join(found.withColumnRenamed("msg", "shape"), "shape").select(F.col("text").alias("form"), "accepted", "exact", at.alias("spans"))
    return with_found(texts.distinct(), g, found).select("text", "accepted", "exact", F.inline("spans"))


DOUBLING = 'S = "b" | S S .'


def _doubled(spark: SparkSession, sf: str):
    """The chart of as many b as each nation's name has characters, its spans, forest and roots."""
    texts = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.repeat(F.lit("b"), F.length("n_name")).alias("text"))
    c, save = chart(texts, "id", "text", DOUBLING), scratch_save(spark)
    spans, lengths = save(c.spans(), "spans"), c.verdicts().select("msg", F.col("source_len").alias("n"))
    return c, ft.forest(spans, c.slots.g, lengths, save), ft.roots_of(spans, c.slots.g, lengths), save


def shared_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The packed edges of all ways to cut the names' stretches in two, and the nodes that they share, by joins alone."""
    c, edges, _, _ = _doubled(spark, sf)
    pair = c.slots.g.rules["S"].alternatives[1].number
    _, o, d, i, j = ft.parts("parent")
    cut = edges.withColumn("o", o).withColumn("d", d).withColumn("at", i).withColumn("to", j).where((F.substring("parent", 1, 1) == "P") & (F.col("o") == pair) & (F.col("d") == 2))
    sharing = cut.groupBy("msg", "right").agg(F.count("*").alias("shared"))
    return cut.join(sharing, ["msg", "right"]).select(F.col("msg").alias("n_nationkey"), F.col("at").cast("long").alias("i"), F.col("k").cast("long").alias("k"), F.col("to").cast("long").alias("j"), "shared")


def derivation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many derivations each name's letters have (all of them, as decimals), and the first ten trees, unranked."""
    _, edges, roots, save = _doubled(spark, sf)
    counted = ft.counts(edges, save)
    listed = ft.trees(edges, counted, roots, 10, save)
    whole = listed.groupBy("msg", "tree").agg(F.sum(F.col("node").startswith("T:").cast("long")).alias("leaves"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "node"))), " "), 256).alias("shape"))
    trees = whole.groupBy("msg").agg(F.count("*").alias("trees"), F.countDistinct("shape").alias("distinct_trees"), F.min("leaves").alias("leaves"))
    rows = roots.join(counted, ["msg", "node"]).join(trees, "msg")
    return rows.select(F.col("msg").alias("n_nationkey"), F.col("n").cast("long").alias("derivations"), "trees", "distinct_trees", "leaves")


SUMS = r"""
space : /\s+/ .
number - /[0-9]+/ .
@left E = E "+" E | number .
"""


def resolved_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the line items' quantities, as many as the line number says, parsed with all ambiguity, pruned, resolved to
    the left and pruned again: the spans of sums that are left."""
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber")
    texts = _table(spark, sf, "lineitem").select(F.array_join(F.array_repeat(q, n.cast("int")), "+").alias("text")).distinct().withColumn("id", F.sha2("text", 256))
    c, save = chart(texts, "id", "text", SUMS), scratch_save(spark)
    lengths = c.verdicts().select("msg", F.col("source_len").alias("n"))
    kept = ft.resolve(save(c.spans(), "spans"), c.slots.g, lengths, save)
    rows = kept.where(F.col("slot") == c.slots.g.rules["E"].number).join(texts.withColumnRenamed("id", "msg"), "msg")
    return rows.select("text", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def closure_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Where chains of adjoining intervals of each order can end: from each line's number on, by one or two."""
    li, save = _table(spark, sf, "lineitem"), scratch_save(spark)
    steps = li.select(F.col("l_orderkey").alias("msg"), F.col("l_linenumber").cast("long").alias("s"), (F.col("l_linenumber") + 1 + F.col("l_suppkey") % 2).cast("long").alias("m"))
    return ft.closure_ends(steps, save, ["msg"])


def _stored(spark: SparkSession, sf: str) -> Index:
    """An index of all documents under the shared folder, brought up to date in two steps."""
    index = Index(spark, f"{scratch_root(spark)}/index")
    d = _table(spark, sf, "documents").select("doc_id", "text")
    index.rebuild(d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))))
    index.update(d)
    return index


def stored_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best chunks from the stored index, after a third of the documents were replaced, with their best windows."""
    hits = _stored(spark, sf).hits("the of NOT worthless")
    return hits.select(F.col("id").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"), "snippet")


def stored_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the stored index that hold a phrase, after every fifth document was deleted."""
    index = _stored(spark, sf)
    index.delete(_table(spark, sf, "documents").where("doc_id % 5 = 0"))
    found = index.matching('"of the"').groupBy("id", "chunk_index").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))
    return found.where(Query('"of the"').holds(F.col("found"))).select(F.col("id").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"))


def bracket_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of brackets of all pages and documents, outside quoted strings. One that nothing closes is not alike."""
    texts = _table(spark, sf, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    texts = texts.unionByName(_table(spark, sf, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text"))
    found = pairs(texts, ["source", "id"], "text")
    return found.select("source", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("depth").cast("long").alias("depth"), F.coalesce("alike", F.lit(False)).alias("alike"))


def scanner_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """How often each terminal was tried and matched on all lines of all turns, as the scanning tasks counted it. Where a
    match can be split, every place is one at which a token may begin."""
    terminals = le.Terminals(compile_grammar(PROSE))
    rows, seen = observed_places(_lines(spark, sf, False), _IDS, "text", terminals)
    scratch_save(spark)(rows, "places")
    return report(spark, seen, terminals)


def _order_grammars(spark: SparkSession, sf: str) -> Grammars:
    """A grammar for each order, which starts with its first rule: a rule for each line number, whose line items give two alternatives
    each. One begins with a call, the other one is empty or two calls. Numbers that the order does not have are tokens."""
    q, p, s = (F.col(c).cast("long") for c in ("l_quantity", "l_partkey", "l_suppkey"))
    call = lambda x: F.concat(F.lit("r"), (x % 7 + 1).cast("string"))
    second = F.when(q % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(call(s), call(p + s)))
    of = F.concat_ws("/", p, s, q)
    both = F.array(F.struct(F.concat(of, F.lit("a")).alias("alt"), F.array(call(p), F.concat(F.lit("t"), (s % 9).cast("string"))).alias("name")), F.struct(F.concat(of, F.lit("b")).alias("alt"), second.alias("name")))
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))  # brings an order together before its items become rows
    li = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", (F.col("l_linenumber") == first).alias("start"))
    made = li.select("l_orderkey", F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rule"), "start", F.explode(both).alias("a"))
    return Grammars(made.select("l_orderkey", "rule", "start", F.lit(0).alias("pos"), "a.*"), ["l_orderkey"], scratch_save(spark), starting="start")


def first_sets(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules of each order's grammar can begin with; "" where one can be nothing."""
    return _order_grammars(spark, sf).begin.select("l_orderkey", "rule", F.coalesce("token", F.lit("")).alias("token"))


def follow_sets(spark: SparkSession, sf: str) -> DataFrame:
    """What can stand after the rules of each order's grammar."""
    return _order_grammars(spark, sf).follow()


def ll1_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that do not say which alternative of a rule comes, or whether a rule that can be nothing does."""
    return _order_grammars(spark, sf).conflicts()


def reachable_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of each order's grammar that its first rule leads to."""
    return _order_grammars(spark, sf).reachable()


_LETTER = "[A-Za-zÀ-ÿ]"
_EDGES_SQL = rf"""
  p AS (SELECT source, id, turn, line, text, unnest(range(0, length(text))) AS start FROM lines),
  s AS (SELECT source, id, turn, line, start, text, substring(text, start + 1, 500) AS rest FROM p WHERE substring(text, start + 1, 1) NOT IN (' ', chr(9), chr(13))),
  m AS (SELECT *, regexp_extract(rest, '^{_LETTER}+') AS w, regexp_extract(rest, '^[0-9]+') AS d, regexp_extract(rest, '^[.]+') AS o FROM s),
  e AS (SELECT source, id, turn, line, text, start, 'word' AS terminal, start + length(w) AS stop, true AS trivia FROM m WHERE w <> ''
    UNION ALL SELECT source, id, turn, line, text, start, 'number', start + length(d), true FROM m WHERE d <> ''
    UNION ALL SELECT source, id, turn, line, text, start, 'comma', start + 1, true FROM m WHERE starts_with(rest, ',')
    UNION ALL SELECT source, id, turn, line, text, start, 'dots', start + length(o), true FROM m WHERE o <> ''
    UNION ALL SELECT source, id, turn, line, text, start, 'dots', start + k, false FROM m, LATERAL (SELECT unnest(range(1, length(o))) AS k) WHERE o <> ''
    UNION ALL SELECT source, id, turn, line, text, start, lit, start + length(lit), true FROM m, (SELECT unnest(['the', 'de', 'in']) AS lit) WHERE w = lit),
  edges AS (SELECT source, id, turn, line, start, terminal, stop, length(text) AS n, CASE WHEN trivia THEN stop + length(regexp_extract(substring(text, stop + 1, 500), '^[ \t\r]+')) ELSE stop END AS after FROM e)
"""
_TURN_LINES = "SELECT 'turn' AS source, conv_id AS id, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations"
_SAME = "x.id = f.id AND x.turn = f.turn AND x.line = f.line"

_GRAMMAR_SQL = (
    """
  li AS (SELECT l_orderkey AS g, concat('r', l_linenumber) AS rule, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem),
  w0 AS (SELECT g, rule, concat(p, '/', s, '/', q, 'a') AS alt, concat('r', p % 7 + 1) AS x, concat('t', s % 9) AS y FROM li
    UNION SELECT g, rule, concat(p, '/', s, '/', q, 'b'), CASE WHEN q % 4 > 0 THEN concat('r', s % 7 + 1) END, CASE WHEN q % 4 > 0 THEN concat('r', (p + s) % 7 + 1) END FROM li),
  rules AS MATERIALIZED (SELECT DISTINCT g, rule FROM w0), n0 AS (SELECT g, rule FROM rules WHERE false),"""
    # A grammar has at most seven rules, so seven rounds find all that can be empty.
    + "".join(f" n{k} AS MATERIALIZED (SELECT DISTINCT g, rule FROM w0 WHERE (x IS NULL OR (g, x) IN (SELECT (g, rule) FROM n{k - 1})) AND (y IS NULL OR (g, y) IN (SELECT (g, rule) FROM n{k - 1})))," for k in range(1, 8))
    + """
  w AS MATERIALIZED (SELECT w0.*, cx.rule IS NOT NULL AS callx, cy.rule IS NOT NULL AS cally, x IS NULL OR vx.rule IS NOT NULL AS voidx, y IS NULL OR vy.rule IS NOT NULL AS voidy FROM w0
    LEFT JOIN rules cx ON cx.g = w0.g AND cx.rule = x LEFT JOIN rules cy ON cy.g = w0.g AND cy.rule = y LEFT JOIN n7 vx ON vx.g = w0.g AND vx.rule = x LEFT JOIN n7 vy ON vy.g = w0.g AND vy.rule = y),
  lead AS MATERIALIZED (SELECT g, rule, x AS name, callx AS call FROM w WHERE x IS NOT NULL UNION SELECT g, rule, y, cally FROM w WHERE voidx AND y IS NOT NULL),
  first(g, rule, token) AS (SELECT g, rule, name FROM lead WHERE NOT call UNION SELECT lead.g, lead.rule, first.token FROM first JOIN lead ON lead.call AND lead.g = first.g AND lead.name = first.rule)"""
)
_FOLLOW_SQL = f"""{_GRAMMAR_SQL},
  ofx AS MATERIALIZED (SELECT w.g, w.rule, alt, token FROM w JOIN first f ON f.g = w.g AND f.rule = x UNION SELECT g, rule, alt, x FROM w WHERE x IS NOT NULL AND NOT callx),
  ofy AS MATERIALIZED (SELECT w.g, w.rule, alt, token FROM w JOIN first f ON f.g = w.g AND f.rule = y UNION SELECT g, rule, alt, y FROM w WHERE y IS NOT NULL AND NOT cally),
  up AS MATERIALIZED (SELECT g, x AS low, rule FROM w WHERE callx AND voidy UNION SELECT g, y, rule FROM w WHERE cally),
  start AS (SELECT l_orderkey AS g, concat('r', min(l_linenumber)) AS rule FROM lineitem GROUP BY l_orderkey),
  follow(g, rule, token) AS (SELECT g, rule, '○' FROM start UNION SELECT w.g, x, token FROM w JOIN ofy USING (g, rule, alt) WHERE callx UNION SELECT up.g, up.low, follow.token FROM follow JOIN up ON up.g = follow.g AND up.rule = follow.rule)"""

ORACLE_SQL: dict[str, str] = {
    "first_sets": f"WITH RECURSIVE {_GRAMMAR_SQL} SELECT g AS l_orderkey, rule, token FROM first UNION ALL SELECT g, rule, '' FROM n7",
    "follow_sets": f"WITH RECURSIVE {_FOLLOW_SQL} SELECT g AS l_orderkey, rule, token FROM follow",
    "ll1_conflicts": f"""WITH RECURSIVE {_FOLLOW_SQL},
        af AS (SELECT g, rule, alt, token FROM ofx UNION SELECT ofy.g, ofy.rule, ofy.alt, token FROM ofy JOIN w USING (g, rule, alt) WHERE voidx UNION SELECT g, rule, alt, '' FROM w WHERE voidx AND voidy),
        ways AS (SELECT g, rule, token FROM af UNION ALL SELECT f.g, f.rule, token FROM follow f JOIN n7 USING (g, rule)),
        stands AS (SELECT w.g, rule, alt, 0 AS pos, x AS name, token FROM w JOIN ofy USING (g, rule, alt) WHERE callx AND voidx UNION SELECT w.g, rule, alt, 0, x, token FROM w JOIN follow USING (g, rule) WHERE callx AND voidx AND voidy
          UNION SELECT w.g, rule, alt, 1, y, token FROM w JOIN follow USING (g, rule) WHERE cally AND voidy)
        SELECT g AS l_orderkey, rule, 'alternatives' AS kind, token, count(*) AS n FROM ways GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT s.g, s.name, 'use', s.token, count(*) FROM stands s JOIN first f ON f.g = s.g AND f.rule = s.name AND f.token = s.token GROUP BY ALL""",
    "reachable_rules": f"""WITH RECURSIVE {_GRAMMAR_SQL}, down AS (SELECT g, rule, x AS low FROM w WHERE callx UNION SELECT g, rule, y FROM w WHERE cally),
        reached(g, rule) AS (SELECT l_orderkey, concat('r', min(l_linenumber)) FROM lineitem GROUP BY l_orderkey UNION SELECT d.g, d.low FROM reached r JOIN down d ON d.g = r.g AND d.rule = r.rule)
        SELECT g AS l_orderkey, rule FROM reached""",
    "lex_edges": f"""WITH lines AS ({_TURN_LINES} UNION ALL SELECT 'document', doc_id, 0, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) - 1 FROM documents), {_EDGES_SQL}
        SELECT source, id, turn, terminal, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends, CAST(sum(after) AS BIGINT) AS afters FROM edges GROUP BY ALL""",
    "filter_chain": f"""WITH lines AS ({_TURN_LINES}), {_EDGES_SQL},
      f1 AS (SELECT * FROM edges f WHERE terminal <> 'comma' OR EXISTS (SELECT 1 FROM edges x WHERE {_SAME} AND x.after = f.start AND x.terminal = 'word')),
      f2 AS (SELECT * FROM f1 f WHERE terminal <> 'word' OR NOT EXISTS (SELECT 1 FROM edges x WHERE {_SAME} AND x.start = f.start AND x.after = f.after AND x.terminal IN ('the', 'de', 'in'))),
      f3 AS (SELECT * FROM f2 f WHERE terminal <> 'word' OR after = n OR EXISTS (SELECT 1 FROM edges x WHERE {_SAME} AND x.start = f.after AND x.terminal IN ('comma', 'dots', 'word'))),
      f4 AS (SELECT * FROM f3 f WHERE terminal <> 'word' OR after = n OR NOT EXISTS (SELECT 1 FROM edges x WHERE {_SAME} AND x.start = f.after AND x.terminal = 'comma')),
      f5 AS (SELECT id, turn, line, start, terminal, after, max(stop) AS stop FROM f4 GROUP BY ALL),
      every AS (SELECT id, turn, terminal, 0 AS stage, start, stop FROM edges UNION ALL SELECT id, turn, terminal, 1, start, stop FROM f1 UNION ALL SELECT id, turn, terminal, 2, start, stop FROM f2
        UNION ALL SELECT id, turn, terminal, 3, start, stop FROM f3 UNION ALL SELECT id, turn, terminal, 4, start, stop FROM f4 UNION ALL SELECT id, turn, terminal, 5, start, stop FROM f5)
      SELECT id, turn, terminal, count(*) FILTER (stage = 0) AS after_0, count(*) FILTER (stage = 1) AS after_1, count(*) FILTER (stage = 2) AS after_2, count(*) FILTER (stage = 3) AS after_3, count(*) FILTER (stage = 4) AS after_4,
        count(*) FILTER (stage = 5) AS after_5, CAST(sum(start) FILTER (stage = 5) AS BIGINT) AS starts, CAST(sum(stop) FILTER (stage = 5) AS BIGINT) AS ends FROM every GROUP BY id, turn, terminal""",
    "chart_spans": """WITH x AS (SELECT DISTINCT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, CAST(l_linenumber AS VARCHAR) AS n, l_linenumber % 3 = 0 AS broken FROM lineitem),
        g AS (SELECT concat(q, ' + ', n, ' * (', p, '+', q, ')') AS text, length(q) AS a, length(n) AS b, length(p) AS c FROM x WHERE NOT broken),
        s AS (SELECT text, unnest([0, a + 3, a + b + 6, a + b + 7, a + b + c + 8]) AS i, unnest([a + 1, a + b + 4, length(text), a + b + c + 7, a + b + c + 8 + a]) AS j FROM g)
      SELECT DISTINCT text, true AS accepted, true AS exact, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM s
      UNION ALL SELECT DISTINCT concat(q, ' + * ', p), false, false, CAST(0 AS BIGINT), CAST(length(q) + 1 AS BIGINT) FROM x WHERE broken""",
    "shared_forest": """WITH n AS (SELECT n_nationkey, length(n_name) AS n FROM nation),
        t AS (SELECT n_nationkey, n, i, k, j FROM n, LATERAL (SELECT unnest(range(0, n)) AS i), LATERAL (SELECT unnest(range(i + 1, n)) AS k), LATERAL (SELECT unnest(range(k + 1, n + 1)) AS j))
      SELECT n_nationkey, i, k, j, count(*) OVER (PARTITION BY n_nationkey, k, j) AS shared FROM t""",
    "derivation_counts": """WITH n AS (SELECT n_nationkey, length(n_name) AS n, length(n_name) - 1 AS m FROM nation)
      SELECT n_nationkey, CAST(round(factorial(CAST(2 * m AS INTEGER)) / (factorial(CAST(m AS INTEGER)) * factorial(CAST(m + 1 AS INTEGER)))) AS BIGINT) AS derivations, CAST(least(10, factorial(CAST(2 * m AS INTEGER)) / (factorial(CAST(m AS INTEGER)) * factorial(CAST(m + 1 AS INTEGER)))) AS BIGINT) AS trees,
        CAST(least(10, factorial(CAST(2 * m AS INTEGER)) / (factorial(CAST(m AS INTEGER)) * factorial(CAST(m + 1 AS INTEGER)))) AS BIGINT) AS distinct_trees, n AS leaves FROM n""",
    "resolved_spans": """WITH t AS (SELECT DISTINCT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_linenumber AS n FROM lineitem), x AS (SELECT *, length(q) AS a, array_to_string(list_transform(range(n), lambda _: q), '+') AS text FROM t),
        k AS (SELECT *, unnest(range(0, n)) AS nth FROM x)
      SELECT DISTINCT text, CAST(i AS BIGINT) AS i, CAST(nth * (a + 1) + a AS BIGINT) AS j FROM k, LATERAL (SELECT unnest([0, nth * (a + 1)]) AS i)""",
    "closure_ends": """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS msg, CAST(l_linenumber AS BIGINT) AS s, CAST(l_linenumber + 1 + l_suppkey % 2 AS BIGINT) AS m FROM lineitem),
        r AS (SELECT msg, s, m FROM e UNION SELECT r.msg, r.s, e.m FROM r JOIN e ON e.msg = r.msg AND e.s = r.m) SELECT msg, s, m FROM r""",
    "stored_hits": f"""WITH {_CHUNKS_SQL}, d AS (SELECT doc_id, chunk_index, piece, {_WORDS.format("piece")} AS words FROM chunks), w AS (SELECT doc_id, chunk_index, unnest(words) AS term FROM d),
        p AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM w WHERE term IN ('the', 'of', 'worthless') GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len(words)) AS a FROM d),
        s AS (SELECT p.doc_id, p.chunk_index, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / a))) AS b,
          bool_or(p.term = 'the') AND bool_or(p.term = 'of') AND NOT bool_or(p.term = 'worthless') AS ok FROM p JOIN f USING (term) JOIN d USING (doc_id, chunk_index), n GROUP BY p.doc_id, p.chunk_index),
        best AS (SELECT doc_id, chunk_index, b, piece FROM s JOIN d USING (doc_id, chunk_index) WHERE ok ORDER BY -b, CAST(doc_id AS VARCHAR), chunk_index LIMIT 8),
        x AS (SELECT *, regexp_split_to_array(piece, '[ \t\n\r]+') AS t, list_transform(regexp_split_to_array(piece, '[ \t\n\r]+'), lambda y: regexp_replace(lower(y), '[^a-z0-9]', '', 'g')) AS u FROM best),
        v AS (SELECT *, list_max(list_transform(range(0, greatest(len(t) - 18, 0) + 1), lambda i: {{'d': len(list_distinct(list_filter(u[i + 1:i + 18], lambda y: y IN ('the', 'of', 'worthless')))), 'h': len(list_filter(u[i + 1:i + 18], lambda y: y IN ('the', 'of', 'worthless'))), 'i': -i}})) AS m FROM x)
      SELECT doc_id, chunk_index, round(-b, 6) AS score, concat(CASE WHEN m.i < 0 THEN ' ... ' ELSE '' END, array_to_string(list_transform(range(1 - m.i, least(18 - m.i, len(t)) + 1), lambda i: CASE WHEN u[i] IN ('the', 'of', 'worthless') THEN concat('[', t[i], ']') ELSE t[i] END), ' '),
        CASE WHEN 18 - m.i < len(t) THEN ' ... ' ELSE '' END) AS snippet FROM v""",
    "stored_phrase": f"""WITH {_CHUNKS_SQL} SELECT doc_id, chunk_index FROM chunks WHERE doc_id % 5 <> 0 AND contains(' ' || array_to_string({_WORDS.format("piece")}, ' ') || ' ', ' of the ')""",
    "bracket_pairs": r"""WITH t AS (SELECT 'page' AS source, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
        c AS (SELECT source, id, regexp_extract_all(text, '(?s)"(?:[^"\\\n]|\\.)*(?:"|\z)?|[()\[\]{}]|[^"()\[\]{}]+') AS x FROM t),
        p AS (SELECT source, id, unnest(x) AS piece, generate_subscripts(x, 1) AS nth FROM c), o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY source, id ORDER BY nth) - length(piece) AS pos FROM p),
        b AS (SELECT source, id, pos, piece, row_number() OVER (PARTITION BY source, id ORDER BY pos) AS n FROM o WHERE piece IN ('(', ')', '[', ']', '{', '}')),
        d AS (SELECT *, sum(CASE WHEN piece IN ('(', '[', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY source, id ORDER BY n) AS s FROM b),
        l AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY source, id ORDER BY n)) AS depth FROM d)
      SELECT a.source, a.id, CAST(a.pos AS BIGINT) AS start, CAST(z.pos AS BIGINT) AS "end", CAST(a.depth AS BIGINT) AS depth, concat(a.piece, z.piece) IN ('()', '[]', '{}') AS alike
      FROM l a LEFT JOIN l z ON z.source = a.source AND z.id = a.id AND z.n = (SELECT min(y.n) FROM l y WHERE y.source = a.source AND y.id = a.id AND y.n > a.n AND y.depth < a.depth) WHERE a.piece IN ('(', '[', '{')""",
    "scanner_telemetry": f"""WITH lines AS ({_TURN_LINES}), {_EDGES_SQL}, c AS (SELECT CAST(sum(length(text) + 1) AS BIGINT) AS n FROM lines)
      SELECT terminal, c.n AS calls, (SELECT count(*) FROM edges e WHERE e.terminal = t.terminal) AS matches FROM (SELECT unnest(['word', 'number', 'comma', 'dots', 'the', 'de', 'in']) AS terminal) t, c""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (first_sets, follow_sets, ll1_conflicts, reachable_rules, lex_edges, filter_chain, chart_spans, shared_forest, derivation_counts, resolved_spans, closure_ends, stored_hits, stored_phrase, bracket_pairs, scanner_telemetry)}
