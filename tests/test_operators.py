"""Operators over tables."""

import pytest
from pyspark.sql import functions as F

from spangrove.functions import text as tx
from spangrove.operators import corpus, search
from spangrove.operators import spans as sp
from spangrove.operators.parse import diagnostics, forest_edges, forest_nodes, parse, parse_distinct, signature_lines, spans, terminal_text, tree_nodes, verdicts
from spangrove.plans.forest import apply, choices
from spangrove.plans.grammar import compile_grammar
from spangrove.plans.kernel import Kernel
from spangrove.sources import emit, files
from spangrove.sources.scratch import scratch_save
from spangrove.streaming.parse_stream import parse_stream, verdicts_by_window

SUM = r'space : /\s+/ . number - /[0-9]+/ . @left E = E "+" E | number .'


def test_parse_table(spark):
    df = spark.createDataFrame([(1, "1 + 2"), (2, None), (3, ""), (4, "1 +"), (1, "1 + 2"), (5, "1" + " + 1" * 30)], "id long, text string")
    rows = {(r.id, r.text): r["parse"] for r in parse(df, SUM, keep=("bsr", "ast", "trees", "forest", "commits", "diagnostics"), resolve=True).collect()}
    assert rows[2, None] is None and not rows[3, ""].accepted and rows[1, "1 + 2"].accepted and rows[4, "1 +"].expected == ["number"]
    assert len(rows[1, "1 + 2"].trees) == 1 and rows[1, "1 + 2"].tokens == 3
    assert rows[5, "1" + " + 1" * 30].accepted and not rows[5, "1" + " + 1" * 30].diagnostics
    assert parse(df.limit(0), SUM).count() == 0
    small = parse(df.where("id = 5"), SUM, most_items=20).first()["parse"]
    assert small.too_large and not small.accepted
    assert parse_distinct(df, SUM).count() == df.count()


@pytest.mark.parametrize("n", [1, 3, 7])
def test_partitions_do_not_matter(spark, n):
    df = spark.range(20).select("id", F.concat_ws(" + ", F.array_repeat("id", 4)).alias("text"))
    got = spans(parse(df.repartition(n), SUM), "id")
    assert got.agg(F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first() == spans(parse(df.coalesce(1), SUM), "id").agg(F.sum(F.xxhash64(*got.columns).cast("decimal(38,0)"))).first()


def test_rules_as_windows_equal_the_kernel(spark):
    grammar = 'S = @prefer A | B S | S S | "b". @right A = S S. @longest B = { "b" } | A.'
    g = compile_grammar(grammar)
    p = Kernel(g).parse("bbbb")
    df = spark.createDataFrame([(1, "bbbb")], "id long, text string")
    table = sp.apply(spans(parse(df, grammar), "id"), choices(g), ["id"])
    for c in choices(g):
        apply(c, p.spans)
    assert {(r.slot, r.i, r.k, r.j) for r in table.collect()} == {(n, *s) for n, x in p.spans.items() for s in x}


def test_relational_twin_equals_the_kernel(spark):
    text = "xxyx"
    p = Kernel(compile_grammar('S = S S | A. A = "x" | A "y".'.replace('A "y"', 'A Y') + ' Y = "y".')).parse(text)
    tokens = spark.createDataFrame([(1, c, i, i + 1) for i, c in enumerate(text)], "msg long, sym string, i int, j int")
    binary = spark.createDataFrame([("S", "S", "S"), ("A", "A", "Y")], "sym string, left string, right string")
    unary = spark.createDataFrame([("S", "A"), ("A", "x"), ("Y", "y")], "sym string, child string")
    got = {(r.i, r.j) for r in sp.derive(tokens, binary, unary, scratch_save(spark)).where("sym = 'S'").collect()}
    assert (0, len(text)) in got and {(i, j) for i, _, j in p.spans[p.grammar.root.number]} <= got


def test_chunks(spark):
    texts = ["", None, "x" * 10, "y" * 11, "z" * 9, " " * 25, "ab " * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(t, size, overlap):
        if overlap >= size:
            overlap = size // 4
        out, s = [], 0
        while t and s < len(t):
            e = min(len(t), s + size)
            if t[s:e].strip():
                out.append((s, e, t[s:e].strip()))
            if e == len(t):
                break
            s = max(s + 1, e - overlap)
        return out

    for size, overlap in ((10, 3), (10, 10), (4, 9), (1, 0), (1400, 250)):
        got = search.chunks(df, size=size, overlap=overlap).orderBy("doc_id", "chunk_index").collect()
        want = [(d, n, *c) for d, t in enumerate(texts) for n, c in enumerate(plain(t, size, overlap))]
        assert [(r.doc_id, r.chunk_index, r.start_offset, r.end_offset, r.text) for r in got] == want
    assert search.chunks(df, size=0).count() == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "a.md", "the quick brown fox"), (2, "b.md", "the lazy dog and the quick cat"), (3, "c.md", "nothing here"), (4, "d.md", "brown quick")], "doc_id long, path string, text string")
    c = search.chunks(docs)
    find = lambda q: {r.path for r in search.hits(docs, c, q).collect()}
    assert find("quick") == {"a.md", "b.md", "d.md"} and find("quick brown") == {"a.md", "d.md"} and find('"quick brown"') == {"a.md"}
    assert find("quick NOT dog") == {"a.md", "d.md"} and find("fox OR dog") == {"a.md", "b.md"} and find("qui* AND (fox OR lazy)") == {"a.md", "b.md"}
    assert search.hits(docs, c, "fox").first().snippet == "the quick brown [fox]" and search.hits(docs, c, "quick").first().score < 0
    with pytest.raises(ValueError):
        search.Query("a AND")
    assert search.hits(docs.limit(0), c.limit(0), "fox").count() == 0


SWIFT = '''
func testOne() {
  assertParse("let a = 1")
  assertParse(#"let s = "x(y)""#, diagnostics: [D(message: "no")])
  assertParse(
    """
      if x { // )
      }
    """, substructure: f(")"))
  assertParse("1\ufe0f\u20e3 @_spi(x) \\" )")
}
func testTwo() { assertParse(source) /* ) */ ; assertParse("b", diagnostics : []) }
func open() { assertParse("never closed"
'''


def test_snippets(spark):
    df = spark.createDataFrame([("dir/File.swift", SWIFT), ("e.swift", None)], "path string, text string")
    got = {(r.label, r.expected): r for r in corpus.snippets(df).collect()}
    assert set(got) == {("testOne#1", "accept"), ("testOne#1", "reject"), ("testOne#2", "accept"), ("testOne#3", "accept"), ("testTwo#1", "reject")}
    assert got["testOne#2", "accept"].source == "  if x { // )\n  }" and got["testOne#1", "reject"].source == 'let s = "x(y)"'
    assert got["testOne#3", "accept"].underscored and "\u20e3" not in got["testOne#3", "accept"].source and got["testOne#1", "accept"].origin == "File.testOne"


def test_corpus_entries(spark):
    text = '''[CaseSnippet(label: "one", source: "a(b)", origin: "x"), CaseSnippet(label: "two", source: #"""
        b "c"
        """#, origin: "x", disabledReason: "later"), CaseSnippet(label: "three")]'''
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert [tuple(r) for r in corpus.corpus_entries(df).collect()] == [("one", "a(b)", False), ("two", 'b "c"', True)]


def test_trees_as_tables(spark):
    df = spark.createDataFrame([(1, "1 + 2"), (2, "nothing")], "id long, text string")
    p = parse(df, SUM, keep=("tree", "commits"), resolve=True)
    rows = sorted(tuple(r) for r in tree_nodes(p, "id").select("id", "node", "parent", "name", "image").collect())
    assert rows == [(1, 0, None, "E", None), (1, 1, 0, "E", None), (1, 2, 0, '"+"', "+"), (1, 3, 0, "E", None), (1, 4, 1, "number", "1"), (1, 5, 3, "number", "2")]
    assert {r.id: r.image for r in terminal_text(p, "text", "id").collect()}[1] == "1+2"


def test_harvest_and_verdicts(spark):
    loose = SUM.replace("@left ", "")
    df = spark.createDataFrame([(0, "1+2+3", "accept"), (1, "1+2+3+4", "accept"), (2, "1+", "reject")], "msg_index int, text string, expected string")
    p = parse(df, loose, keep=("diagnostics",))
    rows = corpus.harvest(diagnostics(p, "msg_index"), spark.createDataFrame([(0, "zero")], "msg_index int, label string")).collect()
    assert rows[0]["count"] == 2 and rows[0].example_tests == "?1,zero" and rows[0].kind == "ambiguous pivot"
    assert signature_lines(p, "msg_index").first().value.startswith("SIG\t0\tE\tambiguous pivot\tbody=[E")
    assert {(r.expected, r.got, r.ambiguous, r["count"]) for r in verdicts(p, "expected").collect()} == {("accept", "accept", True, 2), ("reject", "reject", False, 1)}


def test_files(spark, tmp_path):
    (tmp_path / "src/.git").mkdir(parents=True)
    (tmp_path / "src/a.md").write_text("hello é")
    (tmp_path / "src/b.py").write_text("no")
    (tmp_path / "src/.git/c.md").write_text("no")
    (tmp_path / "src/D.TXT").write_bytes(b"\xff\xfe bad")
    got = {r.path: r for r in files.documents(files.source_files(spark, str(tmp_path / "src"))).collect()}
    assert sorted(r.doc_id for r in got.values()) == [1, 2] and got["D.TXT"].doc_id == 1
    assert set(got) == {"a.md", "D.TXT"} and got["a.md"].text == "hello é" and got["a.md"].size == 8 and "\ufffd" in got["D.TXT"].text
    (tmp_path / "g.grammar").write_text('S = "x". ^^^x^^^#m.txt')
    (tmp_path / "m.txt").write_text("x")
    _, g = files.grammar_file(spark, str(tmp_path / "g.grammar"))
    assert [r.text for r in files.messages(spark, g, str(tmp_path)).collect()] == ["x", "x"]
    files.write_tsv(spark.createDataFrame([(1, 'a"b')], "n int, s string"), str(tmp_path / "t"))
    assert any('1\ta"b' in f.read_text() for f in (tmp_path / "t").glob("part*"))
    files.write_csv(spark.createDataFrame([('a,"b"',)], "s string"), str(tmp_path / "c"))
    assert any('"a,""b"""' in f.read_text() for f in (tmp_path / "c").glob("part*"))


def test_emitters(spark):
    g = compile_grammar(SUM)
    assert 'href="#E"' in emit.grammar_html(g) and "r0 -> r0" in emit.grammar_dot(g)
    p = parse(spark.createDataFrame([(1, "1+2")], "id long, text string"), SUM, keep=("forest",))
    lines = [r.value for r in emit.dot_lines(forest_nodes(p, "id"), forest_edges(p, "id"), "id").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and any("->" in x for x in lines)


def test_scalars(spark):
    df = spark.createDataFrame([("a\r\nb\tc😀d", 6)], "t string, at int")
    row = df.select(tx.line_position(F.col("t"), F.col("at")).alias("p"), tx.column_of(F.col("t"), F.col("at")).alias("c"), tx.escapes_removed(F.lit("\\\\n")).alias("e"), tx.strip(F.lit("\n a \t")).alias("s"), tx.csv_field(F.lit('a"b')).alias("q"), tx.whitespace_visible(F.lit(" \t\n")).alias("w"), tx.is_epsilon(F.lit("ε")).alias("i"), tx.kebab(F.lit("fooBar baz")).alias("k"), tx.identifier(F.lit("9-a")).alias("n"), tx.snippet(F.lit("ab cd"), F.lit(0)).alias("x"), tx.stripped(F.lit("literal"), F.lit('"ab"')).alias("l"), tx.title_case(F.lit("ALL CAPS")).alias("tc"), tx.html(F.lit("<a&")).alias("h")).first()
    assert row.p == "L1P3" and row.c == 9 and row.e == "\\\n" and row.s == "a" and row.q == '"a""b"' and row.w == "·→↵" and row.i and row.k == "foo-bar-baz" and row.n == "_9HyphenMinusa" and row.x == "ab" and row.l == "ab" and row.tc == "All Caps" and row.h == "&lt;a&amp;"
    events = spark.createDataFrame([([0, 4, 2, 2],), ([],), ([3, None, 5, 0],)], "c array<int>").select(tx.indent_events(F.col("c")).alias("e")).collect()
    assert [r.e for r in events] == [["I", "D", "I", "D"], [], ["I", "I", "D", "D"]]


def test_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.node for r in sp.closure(edges, spark.createDataFrame([("a",)], "node string"), scratch_save(spark)).collect()} == {"a", "b", "c"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"{i} + 1" if i % 2 else "+", "2024-01-01 00:0%d:00" % i) for i in range(6)], "id long, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = parse_stream(read(), SUM, keep=()).select("id", "parse.accepted").writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.sql("select sum(int(accepted)), count(*) from parsed").first() == (3, 6)
    q = verdicts_by_window(read(), SUM, "at").writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.sql("select sum(count) from counted").first()[0] == 6
    with pytest.raises(ValueError):
        parse_stream(spark.range(1), SUM)
