"""Parsing a table of texts as joins: the call/return fixpoint, evaluated semi-naively over bucketed tables.

One table of facts holds what is known, bucketed by text once and partitioned by round:

    item   (alternative o, dot d, begin b, vertex v): the body was matched from b up to v
    cend   (closure o, origin b, vertex v): iterations that began at b have come to v

An item before a call or a bracket is also a return edge (owner at v, go on with o, d, b), one at the end of its body a
pop (owner from b ends at v), so returns meet pops by a join of the facts with themselves; iterations of closures meet
their ends in the same way. Each round takes the facts of the last one, joins them with all facts where two meet, and
appends what is new. The buckets hold whole texts, so no join of a round moves a row; only the round's candidates are
dealt to buckets before they are compared with what is known. Rounds end when nothing is new; their number grows with
the longest derivation, not with the number of texts.

A vertex is a place, with the end, terminal and gap of the token before where the grammar looks back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grammar import EPS, Alternative, Element, Grammar, Rule, compile_grammar
from ..sources.scratch import scratch_root
from .lexedges import END, Terminals, _once, lex_places, places

B, V = ["b0", "b1", "b2"], ["v0", "v1", "v2"]
KEY = ["msg", "rel", "o", "d", *B, *V]
#: What is known at v: the gap before, which tests hold there, its matches, the length of the text.
HERE = ["gap", "tests", "edges", "n"]
NEVER, ALWAYS = -1, -2
#: Characters of texts to a bucket, at least.
CHARACTERS = 256
SETTINGS = {
    "requireAllClusterKeysForCoPartition": "false",
    "sources.bucketing.autoBucketedScan.enabled": "false",
    "autoBroadcastJoinThreshold": "-1",
    "adaptive.enabled": "false",
    "sources.partitionOverwriteMode": "static",
    "hive.filesourcePartitionFileCacheSize": "0",
}


class Slots:
    """A grammar as small tables: slots (alternative, dot), alternatives by owner, and tests on a place.

    A test asks whether one of some terminals matches at a place otherwise than with the same end as an excluded one.
    """

    def __init__(self, g: Grammar):
        self.g, self.terminals = g, Terminals(g)
        self.frames: dict[tuple[str, int], tuple[SparkSession, DataFrame]] = {}
        self.tests: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        self.closures = any(e.closure for e in g.elements)
        self.looks_back = any(e.kind == "gap" for e in g.elements) or any(t.behind for t in g.terminals.values())
        self.rows = [self._slot(a, d) for a in g.alternatives for d in range(len(a.elements) + 1)]
        self.opens = [(a.owner.number, a.number, self.test(a.first, a.exclude), self.test(a.owner.follow, a.exclude) if EPS in a.first else NEVER) for a in g.alternatives]

    def test(self, kinds, excluded=()) -> int:
        key = tuple(self.terminals.numbers(kinds)), tuple(self.terminals.numbers(excluded))
        return self.tests.setdefault(key, len(self.tests))

    def viable(self, a: Alternative, dot: int) -> int:
        if dot == len(a.elements) or EPS in a.elements[dot].first:
            return ALWAYS
        return self.test(a.elements[dot].first)

    def _slot(self, a: Alternative, d: int) -> tuple:
        if d == len(a.elements):
            rule = isinstance(a.owner, Rule)
            return (a.number, d, "iter" if a.owner.closure else "end", a.owner.number, a.owner.number, -1, ALWAYS, [], self.test(a.owner.follow) if rule else ALWAYS, NEVER, None, False, "", a.owner is self.g.root)
        e: Element = a.elements[d]
        t = self.terminals.number.get(e.name, -1) if e.kind == "term" else -1
        owner = self.g.rules[e.name].number if e.kind == "call" else e.number
        want = e.ahead or e.follow if e.kind == "term" else ()
        split = bool(e.kind == "term" and self.g.terminals[e.name].split_before)
        behind = self.terminals.behind(e.name) if e.kind == "term" else None
        return (a.number, d, e.kind, e.number, owner, t, self.viable(a, d + 1), [x for x in self.terminals.numbers(e.exclude) if x != t], self.test(want) if want and EPS not in want else ALWAYS, self.test(e.not_ahead) if e.not_ahead else NEVER, behind, split, e.name if e.kind == "gap" else "", False)

    SCHEMA = "o int, d int, kind string, elem int, owner int, t int, next int, excluded array<int>, want int, avoid int, behind array<int>, split boolean, gapkind string, root boolean"

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each place of a dot in the grammar, sent by broadcast."""
        return self._made(spark, "slots", self.rows, self.SCHEMA)

    def open_table(self, spark: SparkSession) -> DataFrame:
        return self._made(spark, "opens", self.opens, "owner int, alt int, s1 int, s2 int")

    def _made(self, spark: SparkSession, name: str, rows: list[tuple], schema: str) -> DataFrame:
        key = name, id(spark)
        if key not in self.frames:
            self.frames[key] = spark, F.broadcast(spark.createDataFrame(rows, schema))
        return self.frames[key][1]

    def held(self, edges: Column) -> Column:
        """The tests that hold at a place with these matches."""
        lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
        every = F.array(*(F.struct(F.lit(i).alias("i"), lit(k).alias("k"), lit(x).alias("x")) for (k, x), i in self.tests.items()))
        free = lambda q, e: ~F.exists(edges, lambda y: F.array_contains(q["x"], y["t"]) & (y["t"] != e["t"]) & (y["after"] == e["after"]))
        return F.transform(F.filter(every, lambda q: F.exists(edges, lambda e: F.array_contains(q["k"], e["t"]) & free(q, e))), lambda q: q["i"])


def holds(tests: Column | str, test: Column) -> Column:
    return (test == ALWAYS) | F.array_contains(tests, test)


@dataclass
class Chart:
    """The facts of all texts, and what follows from them."""

    slots: Slots
    facts: DataFrame
    here: DataFrame
    rounds: int

    def items(self) -> DataFrame:
        return self.facts.where("rel = 'item'")

    def spans(self) -> DataFrame:
        """msg, slot, i, k, j: the element covers k to j in a body that begins at i."""
        at, p = self.items(), ["p0", "p1", "p2"]
        span = lambda df, slot, i, k, j: df.select("msg", F.col(slot).alias("slot"), F.col(i).alias("i"), F.col(k).alias("k"), F.col(j).alias("j"))
        out = span(matched(at, self.here, self.slots), "elem", "b0", "v0", "after").unionByName(span(passed(at), "elem", "b0", "v0", "v0"))
        out = out.unionByName(span(pops(at, False), "owner", "p0", "p0", "w0")).unionByName(span(iterations(at), "owner", "p0", "p0", "w0"))
        met = returns(at).join(pops(self.facts, self.slots.closures), ["msg", "owner", *p]).where(holds("tests", F.col("next")))
        return out.unionByName(span(met, "elem", "b0", "p0", "w0")).distinct()

    def commits(self) -> DataFrame:
        """msg, t, at, start, end, after: terminals as they were matched."""
        return matched(self.items(), self.here, self.slots).select("msg", "t", F.col("v0").alias("at"), "start", "end", "after").distinct()

    def verdicts(self) -> DataFrame:
        """msg, accepted, exact, items, source_len for every text."""
        root = pops(self.items().where("root"), False).where("p0 = 0").select("msg", "w0").distinct()
        ends = root.join(self.here.select("msg", F.col("at").alias("w0"), F.exists("edges", lambda e: e["t"] == END).alias("done"), "n"), ["msg", "w0"])
        good = ends.groupBy("msg").agg(F.max("done").alias("accepted"), F.max(F.col("w0") == F.col("n")).alias("exact"))
        n = self.items().groupBy("msg").agg(F.count("*").alias("items"))
        every = self.here.where("at = 0").select("msg", F.col("n").alias("source_len"))
        no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        return every.join(good, "msg", "left").join(n, "msg", "left").select("msg", no("accepted"), no("exact"), F.coalesce("items", F.lit(0)).alias("items"), "source_len")


def matched(at: DataFrame, here: DataFrame, slots: Slots) -> DataFrame:
    """Items before a terminal with its matches there (start, end, after) that pass what the slot asks for: the token
    before, exclusion by the same end, and what must and must not match behind; and what is known behind."""
    same_end = lambda e: F.exists("edges", lambda y: F.array_contains("excluded", y["t"]) & (y["after"] == e["after"]))
    mine = F.filter("edges", lambda e: (e["t"] == F.col("t")) & ~same_end(e))
    allowed = F.col("behind").isNull() | F.array_contains("behind", F.col("v2"))
    longest = F.array_max(F.transform(F.filter("edges", lambda e: e["t"] == F.col("t")), lambda e: e["end"]))
    mine = F.when(allowed, mine).when(F.col("split"), F.filter(mine, lambda e: e["end"] == longest)).otherwise(F.array().cast(at.schema["edges"].dataType))
    rows = at.where("kind = 'term'").withColumn("e", F.explode(mine)).drop(*HERE).select("*", "e.start", "e.end", "e.after", F.col("e.gap").alias("edge_gap")).drop("e")
    there = here.select("msg", F.col("at").alias("after"), "tests", "edges", "n")
    return rows.join(there, ["msg", "after"]).where((F.col("after") == F.col("n")) | (holds("tests", F.col("want")) & ~F.array_contains("tests", F.col("avoid"))))


def passed(at: DataFrame) -> DataFrame:
    """Items before what may match nothing: ε, a gap that is as it should be, an optional bracket that can be left out."""
    seen = F.when(F.col("gapkind").contains("s"), F.col("gap") > 0).otherwise(F.col("gap") == 2)
    gap = (F.col("kind") == "gap") & (((F.col("gapkind") == "<n>") & (F.col("v0") == F.col("n"))) | (seen == F.col("gapkind").startswith("<")))
    skip = F.col("kind").isin("opt", "star") & holds("tests", F.col("next"))
    return at.where((F.col("kind") == "eps") | gap | skip)


def returns(at: DataFrame) -> DataFrame:
    """Who waits for an owner at a vertex p: o, d, b go on."""
    rows = at.where(F.col("kind").isin("call", "group", "opt", "star", "plus"))
    return rows.select("msg", "owner", *(F.col(v).alias(p) for v, p in zip(V, ("p0", "p1", "p2"))), "o", "d", *B, "elem", "next")


def _ended(rows: DataFrame) -> DataFrame:
    return rows.select("msg", "owner", *(F.col(b).alias(p) for b, p in zip(B, ("p0", "p1", "p2"))), *(F.col(v).alias(w) for v, w in zip(V, ("w0", "w1", "w2"))), *HERE)


def pops(facts: DataFrame, closures: bool = True) -> DataFrame:
    """Owners that end: from vertex p to w. A rule must be followed by something that can follow it; the root may end the text.
    closures: with the iterations that closures have come to."""
    done = (F.col("kind") == "end") & ((F.col("root") & (F.col("v0") == F.col("n"))) | holds("tests", F.col("want")))
    return _ended(facts.where((F.col("rel") == "cend") | done if closures else done))


def iterations(facts: DataFrame) -> DataFrame:
    return _ended(facts.where("kind = 'iter'"))


def begun(facts: DataFrame) -> DataFrame:
    """Closures (owner) that began at vertex q and have an iteration from vertex p."""
    first, p, q = F.col("rel") == "item", ("p0", "p1", "p2"), ("q0", "q1", "q2")
    rows = facts.where(F.col("kind").isin("star", "plus") | ((F.col("rel") == "cend") & (F.col("v0") > F.col("b0"))))
    return rows.select("msg", "owner", *(F.col(v).alias(x) for v, x in zip(V, p)), *(F.when(first, F.col(v)).otherwise(F.col(b)).alias(x) for v, b, x in zip(V, B, q)), *HERE)


def candidates(new: DataFrame, facts: DataFrame, here: DataFrame, slots: Slots) -> DataFrame:
    """What follows in one step from the new facts, with all facts."""
    go_on = [F.lit("item").alias("rel"), F.col("o"), (F.col("d") + 1).alias("d"), *B]

    moved = matched(new, here, slots)
    back = ["end", "t"] if slots.looks_back else [F.lit(-1), F.lit(-1)]
    vertex = [F.col("after").alias("v0"), *(F.col(x).alias(v) if isinstance(x, str) else x.alias(v) for x, v in zip(back, ("v1", "v2")))]
    out = moved.select("msg", *go_on, *vertex, F.col("edge_gap").alias("gap"), "tests", "edges", "n")
    out = out.unionByName(passed(new).select("msg", *go_on, *V, *HERE))
    # Bodies of what is called, and of closures for each place from which an iteration may begin.
    opened = new.where(F.col("kind").isin("call", "group", "opt", "star", "plus") | ((F.col("rel") == "cend") & (F.col("v0") > F.col("b0"))))
    out = out.unionByName(open_bodies(opened.select("msg", "owner", *V, *HERE), slots))

    p, w = ["p0", "p1", "p2"], [F.col(x).alias(v) for x, v in zip(("w0", "w1", "w2"), V)]
    for waits, ends in ((new, facts), (facts, new)):
        met = returns(waits).join(pops(ends, slots.closures), ["msg", "owner", *p]).where(holds("tests", F.col("next")))
        out = out.unionByName(met.select("msg", *go_on, *w, *HERE))
    if slots.closures:
        for origins, ends in ((new, facts), (facts, new)):
            met = begun(origins).drop(*HERE).join(iterations(ends), ["msg", "owner", *p])
            out = out.unionByName(met.select("msg", F.lit("cend").alias("rel"), F.col("owner").alias("o"), F.lit(-1).alias("d"), *(F.col(x).alias(b) for x, b in zip(("q0", "q1", "q2"), B)), *w, *HERE))
    return out


def open_bodies(opened: DataFrame, slots: Slots) -> DataFrame:
    """Items at the start of the alternatives that can begin at a vertex (owner, v)."""
    rows = opened.join(slots.open_table(opened.sparkSession), "owner")
    ok = F.array_contains("tests", F.col("s1")) | F.array_contains("tests", F.col("s2"))
    return rows.where(ok).select("msg", F.lit("item").alias("rel"), F.col("alt").alias("o"), F.lit(0).alias("d"), *(F.col(v).alias(b) for v, b in zip(V, B)), *V, *HERE)


def chart(df: DataFrame, id_col: str, text_col: str, grammar: str | Grammar, builders: dict[str, str] | None = None, start: str = "") -> Chart:
    """The chart of every text. id_col must tell the texts apart; a null text is empty."""
    g = grammar if isinstance(grammar, Grammar) else compile_grammar(grammar, builders, start)
    slots, spark = Slots(g), df.sparkSession
    name, root = f"chart_{uuid.uuid4().hex}", scratch_root(spark)
    # A round has a task for each bucket and step, however little is in it: few short texts share a bucket.
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.length(text_col))).first()
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n, -(-(size or 0) // CHARACTERS)))
    # Settings of a session of its own: a bucketing by text serves joins on text and place, and tables are listed anew
    # whenever a plan runs, so that the plans of a round are made once.
    own = spark.newSession()
    for k, v in SETTINGS.items():
        own.conf.set(f"spark.sql.{k}", v)

    def create(rows: DataFrame, table: str) -> DataFrame:
        held = rows.withColumn("part", F.lit(0)).repartition(buckets, "msg")
        held.write.partitionBy("part").bucketBy(buckets, "msg").option("path", f"{root}/{name}_{table}").saveAsTable(f"{name}_{table}")
        return own.table(f"{name}_{table}").drop("part")

    def put(rows: DataFrame, table: str, over: bool = False) -> None:
        rows.withColumn("part", F.lit(0)).write.mode("overwrite" if over else "append").insertInto(f"{name}_{table}")

    lexed = lex_places(df.select(F.col(id_col).alias("msg"), text_col), ["msg"], text_col, slots.terminals).withColumn("tests", slots.held(F.col("edges")))
    lexed.write.parquet(f"{root}/{name}_lexed")
    here = create(own.read.parquet(f"{root}/{name}_lexed"), "here")
    seed = here.where("at = 0").select("msg", F.lit(g.root.number).alias("owner"), F.lit(0).alias("v0"), F.lit(-1).alias("v1"), F.lit(-1).alias("v2"), *HERE)
    facts = create(placed(open_bodies(seed, slots), slots), "facts")
    deltas = [create(facts, "even"), create(facts.limit(0), "odd")]
    steps = [fresh(new, facts, here, slots, buckets) for new in deltas]
    k = 0
    while not deltas[k % 2].isEmpty():
        put(steps[k % 2], ("odd", "even")[k % 2], True)
        k += 1
        put(deltas[k % 2], "facts")
    out = Chart(slots, spark.read.schema(facts.schema).parquet(f"{root}/{name}_facts"), spark.read.schema(here.schema).parquet(f"{root}/{name}_here"), k)
    for table in ("facts", "here", "even", "odd"):
        own.sql(f"DROP TABLE {name}_{table}")  # the files stay for who reads the chart
    return out


def shape(text: Column, terminals: Terminals) -> Column:
    """shape, places: what decides about the chart of a text, as a hash, and the places that occur in it in order. Texts of
    one shape have one chart but for their places: it compares places with each other and nothing else."""

    def listed(x: Column) -> Column:
        of = lambda e: F.array(e["start"], e["end"], e["after"])
        seen = F.flatten(F.transform(x["found"], lambda p: F.concat(F.array(p["at"]), F.flatten(F.transform(p["edges"], of)))))
        return F.struct(x["found"].alias("found"), F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), x["n"]), seen))).alias("places"))

    def ranked(z: Column) -> Column:
        rank = lambda v: F.array_position(z["places"], v)
        edge = lambda e: F.struct(e["t"].alias("t"), rank(e["start"]).alias("s"), rank(e["end"]).alias("e"), rank(e["after"]).alias("a"), e["gap"].alias("g"))
        same = F.transform(z["found"], lambda p: F.struct(rank(p["at"]).alias("p"), p["gap"].alias("g"), F.transform(p["edges"], edge).alias("x")))
        return F.struct(F.sha2(F.to_json(F.struct(same.alias("s"), F.size(z["places"]).alias("n"))), 256).alias("shape"), z["places"].alias("places"))

    first = F.struct(places(text, terminals).alias("found"), F.length(text).alias("n"))
    return _once(_once(first, listed), ranked)


def fresh(new: DataFrame, facts: DataFrame, here: DataFrame, slots: Slots, buckets: int) -> DataFrame:
    """What follows from the new facts and is not known; the candidates are dealt to the buckets, and nothing else."""
    found = candidates(new, facts, here, slots).repartition(buckets, "msg").dropDuplicates(KEY)
    return placed(found.join(facts.select(*KEY), KEY, "left_anti"), slots).select(*facts.columns)


def placed(facts: DataFrame, slots: Slots) -> DataFrame:
    """facts with what the grammar says about their alternative and dot; of closures' ends their owner only."""
    return facts.join(slots.table(facts.sparkSession), ["o", "d"], "left").withColumn("owner", F.coalesce("owner", "o"))
