"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded selection.

1. Sources in code-point order (null last) weigh 1, 2, 3 and so on in turn and share all words; a target stops at
   three times its source's size, and what is over goes to the others by weight until none is above.
2. All words are cut into blocks of `block` words; sources get whole blocks by the highest quotients target / (2k + 1).
   Only quotients that can decide are made: at most S / 2 seats move away from the rounded shares of S parties, in
   proportion to those shares, so about six quotients for each party hold every deciding one (see `highest_quotients`).
3. A source is dealt to shards of about SHARD words by a seeded hash, and its blocks go to them by the same rule.
4. In a shard, documents lie one after another in seeded order, as one ring of words. Its blocks are read from the ring
   one after another, `block` words each, so every document is taken as often as the ring is gone round, once more
   where the last round reaches it, and in part where that round ends.

Equal documents (id, source, size, text) are counted before any shuffle and spread out again at the end. A source that
holds a third of all rows is cut into shards; its figures reach its rows by broadcast, at most four such sources for each
partition, the others by a shuffle. The choice rests on ids, texts and the seed, not on how rows are dealt to tasks.

A null text has size 0, as has one of white space only; such documents are taken 0 times and get a row. Null ids and repeated
rows are documents like others, each with its own row. A source without words has target 0. Ties of quotients go to the
first source or shard. Other columns are not read, whatever their names. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_facts, table

WORD = r"[^\x20\x09-\x0D]+"
SHARD = 1 << 20
COPIES = 1 << 12


def key_of(source: Column) -> Column:
    """A key that is never null and sorts like the source, null last."""
    return F.when(source.isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit("="), source.cast("string")))


def ranked(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """rows with their rank (from 0) by the unique key: sorted by ranges, places within a range, ranges by their counts."""
    order = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).withColumn("range", F.spark_partition_id())
    placed = scratch.save(order.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(key))), "ranked")
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    starts = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    # As many rows as shuffle partitions.
    return placed.join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + F.col("place") - 1).drop("range", "place", "start")


def water_fill(sources: DataFrame, most: int) -> DataFrame:
    """sources (source_size, weight) with target: shares by weight of all words, none above most times the size.

    Each round finds who is above by exact integers and sends two sums to the driver; it ends when none is added.
    """
    big = "decimal(38,0)"
    cap, weight = (F.col("source_size") * most).cast(big), F.col("weight").cast(big)
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_ = int(total or 0), int(weights or 0)
    while True:
        above = cap * F.lit(open_).cast("decimal(18,0)") < F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(10,0)") if open_ else F.lit(True)
        sizes, gone = sources.where(above).agg(F.sum("source_size"), F.sum("weight")).first()
        now = int(total or 0) - most * int(sizes or 0), int(weights or 0) - int(gone or 0)
        if now == (left, open_):
            break
        left, open_ = now
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(open_ or 1))
    return sources.withColumn("target", F.when(above, F.col("source_size").cast("double") * most).otherwise(share))


def highest_quotients(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """parties with quota: each group's seats go to the highest quotients votes / (2k + 1), ties to the least party.

    With P parties of a group and shares s_i of its seats, the rounded shares add up to the seats within P / 2, and so do
    they at the divisor that gives the result; hence a party's quota lies within p_i P / 2 + 1 of its rounded share,
    p_i being its part of the votes. Seats below that range are certain, quotients above it cannot win, and those within
    it, fewer than P + 6 for each party and 6 P for the group, are ranked.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    some = parties.where((F.col(votes) > 0) & (F.col(seats) > 0))
    p = some.withColumn("part", F.col(votes) / F.sum(votes).over(w)).withColumn("parties", F.count("*").over(w))
    near = F.floor(F.col("part") * F.col(seats) + 0.5)
    reach = F.ceil(F.col("part") * F.col("parties") / 2) + 2
    p = p.withColumn("sure", F.greatest(near - reach, F.lit(0)).cast("long")).withColumn("over", (near + reach).cast("long"))
    p = p.withColumn("rest", F.col(seats) - F.sum("sure").over(w)).drop("part", "parties")
    quotients = p.select(*group, party, "rest", F.explode(F.sequence("sure", F.col("over") - 1)).alias("k"), votes)
    order = w.orderBy((F.col(votes).cast("double") / (2 * F.col("k") + 1)).desc(), party)
    won = quotients.withColumn("at", F.row_number().over(order)).where("at <= rest").groupBy(*group, party).agg(F.count("*").alias("won"))
    sure = p.select(*group, party, "sure").join(won, [*group, party], "left").select(*group, party, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))
    return parties.join(sure, [*group, party], "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, block: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, quota (words of the document's shard), taken for every document.

    block: words of a block; 0 takes a hundredth of the least target above 0, within 1 and 1024.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text, F.lit(seed)).alias("text_hash"))
    items = scratch.save(rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies")).withColumn("key", key_of(F.col("source"))), "items")

    sources = items.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("held"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = scratch.save(ranked(scratch.save(sources, "sources"), "key", scratch).withColumn("weight", weight), "weighed")
    targets = scratch.save(water_fill(weighed, most), "targets")
    total, least = targets.where("target > 0").agg(F.sum("source_size"), F.min("target")).first()
    words = block or min(max(int((least or 0) / 100), 1), 1024)
    blocks = int((2 * int(total or 0) + words) // (2 * words))
    quotas = scratch.save(highest_quotients(targets.withColumn("blocks", F.lit(blocks).cast("long")), [], "key", "target", "blocks").drop("blocks", "rank", "weight"), "quotas")

    shards = F.ceil((F.col("source_size") + F.col("held")) / SHARD).cast("long")
    placed = join_facts(items, quotas.withColumn("shards", shards), ["key"], "held")
    hashed = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    placed = scratch.save(placed.withColumn("order", hashed).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(seed)), "shards")).drop("shards", "text_hash"), "placed")
    sizes = placed.groupBy("key", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("quota").alias("quota"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    sizes = scratch.save(sizes, "sizes")
    dealt = highest_quotients(sizes.withColumnRenamed("quota", "blocks"), ["key"], "shard", "words", "blocks")
    dealt = dealt.select("key", "shard", "words", "source_size", "target", F.least(F.col("quota") * words, F.col("words") * most).alias("quota"))

    # A shard's ring begins at a seeded place; a document lies at [at, at + size) from there.
    w = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size")
    lying = placed.drop("quota", "source_size", "target").join(dealt, ["key", "shard"])
    lying = lying.withColumn("at", F.sum(F.col("size") * F.col("copies")).over(w) - F.col("size") * F.col("copies"))
    begin = F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest("words", F.lit(1)))
    lying = lying.withColumn("begin", begin).withColumn("rounds", F.floor(F.col("quota") / F.greatest("words", F.lit(1)))).withColumn("last", F.col("quota") - F.col("rounds") * F.col("words"))
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    one = F.explode(F.sequence(F.col("chunk") * COPIES, F.least(F.col("copies"), (F.col("chunk") + 1) * COPIES) - 1))
    each = lying.withColumn("chunk", many).withColumn("copy", one).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    overlap = lambda a, b: F.greatest(F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a), F.lit(0))
    end = F.col("begin") + F.col("last")
    reached = overlap(F.col("begin"), F.least(end, F.col("words"))) + overlap(F.lit(0), end - F.col("words"))
    taken = (F.col("rounds") * F.col("size") + reached).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", "quota", taken.alias("taken"))


def op12_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "op12")).select("doc_id", "size", "source_size", "target", "taken")
