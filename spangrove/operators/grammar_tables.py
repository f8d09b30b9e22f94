"""FIRST, FOLLOW, empty rules, LL(1) conflicts and reachable rules of many grammars at once, as rounds of joins.

A table of productions has a row for each element: the grammar's ids, rule, alt (which alternative), pos (the order
within it) and name. A name that has productions of its own in the same grammar is a rule, any other one a terminal; an
alternative of nothing is one row whose name is null. A name may be an array: the elements from pos on. Rows whose ids, rule, alt or pos are null are left out; equal rows
count once. A table of traits (ids, rule, optional, closure) may say which rules are brackets that can be skipped or
repeated.

Everything but emptiness is the spreading of tokens over a graph whose size is that of the productions: a rule leads to
what can begin its alternatives, an element to what stands after it, and a rule's FOLLOW to the FOLLOW of rules that end
with it. Grammars of up to `most` rows are dealt to tasks whole and worked off in batches (`grammar_sets`), many at once;
a larger one is spread over all tasks: a round takes the last round's facts only, there are as many rounds as the longest
way in a graph. `save(df, name)` writes a table to a folder that all executors share.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..plans.grammar import EOS, EPS, Grammar
from .grammar_sets import CLOSURE, MARKS, OPTIONAL, SCHEMAS, START, analysed

Save = Callable[[DataFrame, str], DataFrame]
PRODUCTION = "rule string, alt string, pos int, name string"
#: Rows of a grammar that goes into a batch with others.
MOST = 1 << 10


def spread(facts: DataFrame, edges: DataFrame, ids: list[str], save: Save, tag: str) -> DataFrame:
    """ids, node, token: the facts, and each one again at every src from which edges (ids, src, dst) lead to its node."""
    edges = edges.select(*ids, "src", F.col("dst").alias("node")).distinct()
    seen = delta = save(facts.select(*ids, "node", "token").distinct(), f"{tag}0")
    edges = save(edges, f"{tag}_edges")
    for k in itertools.count(1):
        step = delta.join(edges, [*ids, "node"]).select(*ids, F.col("src").alias("node"), "token").distinct()
        delta = save(step.join(seen, [*ids, "node", "token"], "left_anti"), f"{tag}{k}")
        if delta.isEmpty():
            return seen
        seen = seen.unionByName(delta)


def _place(kind: str, rule: Column | str, alt: Column | str = "", pos: Column | int = -1) -> Column:
    """A node: the FOLLOW (F) of a rule, or the elements of an alternative from a position on (S)."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), as_column(rule).alias("rule"), as_column(alt).alias("alt"), as_column(pos).cast("int").alias("pos"))


def _listed(productions: DataFrame, ids: list[str], *more: Column) -> DataFrame:
    """ids, rule, alt, pos, name (an array): whole rows only."""
    held = F.col("name") if isinstance(productions.schema["name"].dataType, ArrayType) else F.array("name")
    rows = productions.select(*ids, F.col("rule").cast("string").alias("rule"), F.col("alt").cast("string").alias("alt"), F.col("pos").cast("int").alias("pos"), held.cast("array<string>").alias("name"), *more)
    return rows.dropna(subset=[*ids, "rule", "alt", "pos"])


class Joined:
    """The analyses of a table of grammars of any size by joins; each is made once, when it is first asked for."""

    def __init__(self, productions: DataFrame, ids: list[str], save: Save, traits: DataFrame | None = None):
        self.ids, self.save = ids, save
        self.productions = _listed(productions, ids)
        self.traits = None if traits is None else traits.select(*ids, "rule", "optional", "closure")

    @cached_property
    def rows(self) -> DataFrame:
        """The distinct productions; call: the name is a rule."""
        rows = self.productions.select(*self.ids, "rule", "alt", "pos", F.posexplode_outer("name").alias("k", "name")).withColumn("pos", F.col("pos") + F.coalesce("k", F.lit(0))).drop("k").distinct()
        rules = self.save(rows.select(*self.ids, "rule").distinct(), "rules")
        called = rules.select(*self.ids, F.col("rule").alias("name"), F.lit(True).alias("call"))
        return self.save(rows.join(called, [*self.ids, "name"], "left").withColumn("call", F.coalesce("call", F.lit(False))).select(*self.ids, "rule", "alt", "pos", "name", "call"), "rows")

    @cached_property
    def empty(self) -> DataFrame:
        """ids, rule: rules that can be nothing. An element that is found to be one leaves the list of what an alternative
        waits for; an alternative that waits for nothing makes its rule one."""
        ids, key = self.ids, [*self.ids, "rule", "alt"]
        holds = F.max((F.col("name").isNotNull() & ~F.col("call")).cast("int"))
        alts = self.save(self.rows.groupBy(*key).agg(holds.alias("token")).where("token = 0").drop("token"), "empty_alts")
        todo = self.save(self.rows.where("call").join(alts, key, "left_semi").select(*key, "name").distinct(), "empty_todo0")
        seen = None
        for k in itertools.count(1):
            new = alts.join(todo, key, "left_anti").select(*ids, "rule").distinct()
            if seen is None and self.traits is not None:
                new = new.unionByName(self.traits.where("optional").select(*ids, "rule")).distinct()
            new = self.save(new if seen is None else new.join(seen, [*ids, "rule"], "left_anti"), f"empty{k}")
            if new.isEmpty():
                return new if seen is None else seen
            seen = new if seen is None else seen.unionByName(new)
            todo = self.save(todo.join(new.withColumnRenamed("rule", "name"), [*ids, "name"], "left_anti").select(*key, "name"), f"empty_todo{k}")

    @cached_property
    def elements(self) -> DataFrame:
        """The rows with: void (the element can be nothing), leads (all before it can), ends (all after it can), then (the
        next position), inner (there is one before it)."""
        key = [*self.ids, "rule", "alt"]
        known = self.empty.select(*self.ids, F.col("rule").alias("name"), F.lit(True).alias("void"))
        rows = self.rows.join(known, [*self.ids, "name"], "left").withColumn("void", F.col("name").isNull() | F.coalesce("void", F.lit(False)))
        w = Window.partitionBy(*key)
        before, after = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("pos"), F.col("pos").desc()))
        every = lambda over: F.coalesce(F.min("void").over(over), F.lit(True))
        then, inner = F.lead("pos").over(w.orderBy("pos")), F.lag("pos").over(w.orderBy("pos")).isNotNull()
        return self.save(rows.withColumn("leads", every(before)).withColumn("ends", every(after)).withColumn("then", then).withColumn("inner", inner), "elements")

    @cached_property
    def first(self) -> DataFrame:
        """ids, rule, token: the terminals that a rule can begin with."""
        lead = self.elements.where("leads and name is not null")
        facts = lead.where("not call").select(*self.ids, F.col("rule").alias("node"), F.col("name").alias("token"))
        edges = lead.where("call").select(*self.ids, F.col("rule").alias("src"), F.col("name").alias("dst"))
        return spread(facts, edges, self.ids, self.save, "first").withColumnRenamed("node", "rule")

    def _own(self, elements: DataFrame) -> DataFrame:
        """The elements with the tokens that each of them, alone, can begin with."""
        tokens = self.first.withColumnRenamed("rule", "name")
        return elements.where("call").join(tokens, [*self.ids, "name"]).unionByName(elements.where("not call and name is not null").withColumn("token", F.col("name")))

    @cached_property
    def alternative_first(self) -> DataFrame:
        """ids, rule, alt, token: the terminals that an alternative can begin with, "" where it can be nothing."""
        key = [*self.ids, "rule", "alt"]
        nothing = self.elements.where("leads and ends and void").select(*key, F.lit(EPS).alias("token"))
        return self._own(self.elements.where("leads")).select(*key, "token").unionByName(nothing).distinct()

    def follow(self, starts: DataFrame) -> DataFrame:
        """ids, rule, token: what can stand after a rule, the end (○) after the start rules (ids, rule)."""
        return self._after(starts).where("node.kind = 'F'").select(*self.ids, "node.rule", "token")

    def _after(self, starts: DataFrame) -> DataFrame:
        """ids, node, token for the FOLLOW of all rules, and for what stands after each call within its alternative."""
        key = starts.semanticHash()
        held = self.__dict__.setdefault("_held", {})
        if key not in held:
            ids, e = self.ids, self.elements
            # Nothing leads to an alternative's first element, so what it begins with stands after nothing.
            facts = self._own(e.where("inner")).select(*ids, _place("S", F.col("rule"), F.col("alt"), F.col("pos")).alias("node"), "token")
            facts = facts.unionByName(starts.dropna().select(*ids, _place("F", F.col("rule").cast("string")).alias("node"), F.lit(EOS).alias("token")))
            rest = _place("S", F.col("rule"), F.col("alt"), F.col("then"))
            edges = e.where("void and then is not null").select(*ids, _place("S", F.col("rule"), F.col("alt"), F.col("pos")).alias("src"), rest.alias("dst"))
            follow = _place("F", F.col("name"))
            edges = edges.unionByName(e.where("call and then is not null").select(*ids, follow.alias("src"), rest.alias("dst")))
            edges = edges.unionByName(e.where("call and ends").select(*ids, follow.alias("src"), _place("F", F.col("rule")).alias("dst")))
            if self.traits is not None:
                again = self.first.join(self.traits.where("closure").select(*ids, "rule"), [*ids, "rule"])
                facts = facts.unionByName(again.select(*ids, _place("F", F.col("rule")).alias("node"), "token"))
            held[key] = spread(facts, edges, ids, self.save, f"follow{len(held)}_")
        return held[key]

    def conflicts(self, starts: DataFrame) -> DataFrame:
        """ids, rule, kind, token, n. alternatives: n alternatives of the rule begin with the token, or are empty before it.
        use: at n places where a rule that can be nothing is called, the token can begin it and can follow it too."""
        ids = self.ids
        after = self.save(self._after(starts), f"after{len(self.__dict__['_held'])}")
        follow = after.where("node.kind = 'F'").select(*ids, F.col("node.rule").alias("rule"), "token")
        ways = self.alternative_first.select(*ids, "rule", "token").unionByName(follow.join(self.empty, [*ids, "rule"]).select(*ids, "rule", "token"))
        clash = ways.groupBy(*ids, "rule", "token").agg(F.count("*").alias("n")).where("n > 1").withColumn("kind", F.lit("alternatives"))
        calls = self.elements.where("call and void")
        place = [*ids, "rule", "alt", "pos", "name"]
        inside = after.where("node.kind = 'S'").select(*ids, "node.rule", "node.alt", F.col("node.pos").alias("then"), "token").join(calls, [*ids, "rule", "alt", "then"])
        outside = follow.join(calls.where("ends"), [*ids, "rule"])
        stands = inside.select(*place, "token").unionByName(outside.select(*place, "token")).distinct()
        used = stands.join(self.first.withColumnRenamed("rule", "name"), [*ids, "name", "token"])
        use = used.groupBy(*ids, F.col("name").alias("rule"), "token").agg(F.count("*").alias("n")).withColumn("kind", F.lit("use"))
        return clash.select(*ids, "rule", "kind", "token", "n").unionByName(use.select(*ids, "rule", "kind", "token", "n"))

    def reachable(self, starts: DataFrame) -> DataFrame:
        """ids, rule: the rules that the start rules (ids, rule) lead to, themselves with them."""
        facts = starts.dropna().select(*self.ids, F.col("rule").cast("string").alias("node"), F.lit("").alias("token"))
        edges = self.rows.where("call").select(*self.ids, F.col("name").alias("src"), F.col("rule").alias("dst"))
        return spread(facts, edges, self.ids, self.save, "reached").select(*self.ids, F.col("node").alias("rule"))


class Grammars(Joined):
    """The analyses of a table of grammars: small ones in batches, the others by joins. starting: a column of the productions
    that says which rows' rules are start rules, for analyses that are not given any."""

    def __init__(self, productions: DataFrame, ids: list[str], save: Save, traits: DataFrame | None = None, starting: str = "", most: int = MOST):
        super().__init__(productions, ids, save, traits)
        self.most, self.made = most, {}
        self.starting = _listed(productions, ids, F.col(starting).alias("_mark")) if starting else None

    def _starts(self, starts: DataFrame | None) -> DataFrame:
        if starts is None:
            return self.starting.where("_mark").select(*self.ids, "rule").distinct()
        return starts.select(*self.ids, F.col("rule").cast("string").alias("rule")).dropna()

    def _dealt(self, starts: DataFrame | None) -> DataFrame:
        """The rows of each grammar in one place and next to each other, with the number of the rows and marks of rules."""
        mark = lambda *bits: sum((F.when(c, b).otherwise(0) for c, b in bits), F.lit(0)).cast("int").alias("_mark")
        columns = [*self.ids, "rule", "alt", "pos", "name"]
        rows = self.productions.select(*columns, mark()) if self.starting is None else self.starting.select(*columns, mark((F.col("_mark"), START)))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("alt", "string"), ("pos", "int"), ("name", "array<string>"))]
        if starts is not None:
            rows = rows.unionByName(self._starts(starts).select(*self.ids, "rule", *nothing, mark((F.lit(True), START))))
        if self.traits is not None:
            traits = self.traits.dropna(subset=[*self.ids, "rule"])
            rows = rows.unionByName(traits.select(*self.ids, F.col("rule").cast("string").alias("rule"), *nothing, mark((F.col("optional"), OPTIONAL), (F.col("closure"), CLOSURE))))
        size = F.count("*").over(Window.partitionBy(*self.ids))
        return rows.select(*columns, (size * MARKS + F.col("_mark")).alias("_mark"))

    def _of(self, what: str, starts: DataFrame | None = None, joined: Callable[..., DataFrame] | None = None) -> DataFrame:
        """The rows of an analysis, of all grammars."""
        key = what, None if starts is None else starts.semanticHash()
        if key not in self.made:
            dealt, ids, most = self._dealt(starts), self.ids, self.most
            out = StructType([*dealt.select(*ids).schema.fields, *StructType.fromDDL(SCHEMAS[what]).fields])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                from pyspark.sql.pandas.types import to_arrow_schema

                return analysed(what, len(ids), most, batches, to_arrow_schema(out))

            found = self.save(dealt.mapInArrow(run, out), f"{what}{len(self.made)}")
            large = found.where("rule is null").select(*ids).distinct()
            found = found.where("rule is not null")
            if not large.isEmpty():
                # A start or trait alone may be all that makes a grammar large.
                of = lambda df: df.join(large, ids, "left_semi")
                n = len(self.made)
                one = Joined(of(self.productions), ids, lambda df, name: self.save(df, f"large{n}_{name}"), None if self.traits is None else of(self.traits))
                found = found.unionByName(joined(one, of(self._starts(starts))) if what in ("follow", "conflicts", "reached") else joined(one))
            self.made[key] = found
        return self.made[key]

    @cached_property
    def begin(self) -> DataFrame:
        """ids, rule, token: what rules can begin with; a row without a token where one can be nothing."""
        return self._of("begin", None, lambda g: g.first.unionByName(g.empty.withColumn("token", F.lit(None).cast("string"))))

    @cached_property
    def empty(self) -> DataFrame:
        return self.begin.where("token is null").select(*self.ids, "rule")

    @cached_property
    def first(self) -> DataFrame:
        return self.begin.where("token is not null")

    @cached_property
    def alternative_first(self) -> DataFrame:
        return self._of("alternative", None, lambda g: g.alternative_first)

    def follow(self, starts: DataFrame | None = None) -> DataFrame:
        return self._of("follow", starts, lambda g, s: g.follow(s))

    def conflicts(self, starts: DataFrame | None = None) -> DataFrame:
        return self._of("conflicts", starts, lambda g, s: g.conflicts(s))

    def reachable(self, starts: DataFrame | None = None) -> DataFrame:
        return self._of("reached", starts, lambda g, s: g.reachable(s))


def productions_of(spark: SparkSession, grammars: dict[str, Grammar]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(productions, traits, starts) of compiled grammars by name; brackets are rules named after their numbers."""
    rows, traits, starts = [], [], []
    for name, g in grammars.items():
        label = {r.number: r.name for r in g.rules.values()}
        for o in [*g.rules.values(), *(e for e in g.elements if e.bracket)]:
            rule = label.get(o.number, f"#{o.number}")
            traits.append((name, rule, o.kind in ("opt", "star"), o.closure))
            for a in o.alternatives:
                made = [(p, f"#{e.number}" if e.bracket else e.name) for p, e in enumerate(a.elements) if e.kind not in ("eps", "gap")]
                rows += [(name, rule, str(a.number), p, x) for p, x in made or [(0, None)]]
        starts.append((name, g.root.name))
    return (
        spark.createDataFrame(rows, f"grammar string, {PRODUCTION}"),
        spark.createDataFrame(traits, "grammar string, rule string, optional boolean, closure boolean"),
        spark.createDataFrame(starts, "grammar string, rule string"),
    )
