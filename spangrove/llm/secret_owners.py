"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Regular expressions find candidates; a candidate's value is hashed, and each hash is counted by distinct repositories
and distinct owners over the corpus (first by hash and repository, then by hash and owner, then by hash, so that a
value that a third of all rows hold is reduced before each shuffle). A value that many owners hold is a widely copied
example; one that few hold, and that does not look like a placeholder, is live-looking. Base spans (assign, access,
hex) are always returned; candidates of known token shapes (kind key) are returned where they are live-looking. Hashes
that many rows hold go back to their candidates by broadcast, at most four for each partition; the rest by a shuffle.

Offsets are sums of lengths in code points of the matches and of what lies between them. Null and empty texts have no
spans; a null owner or repository counts as one of its own; each input row, repeated ones too, gives one row, an empty
table none; spans that start together stand in the order of their kinds; other columns are not read, whatever their
names. A text of any length is matched whole in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, clear_name, join_facts, numbered, table

# The patterns of the base, and well-known shapes of tokens.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",  # a shorter match holds no other start that could reach 18 characters
    "hex": r"[0-9a-f]{16,}",
    # the last shape starts a run, so that each run is read at most three times however often eyJ stands in it
    "key": r"gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
}
KINDS = list(PATTERNS)
BASE = 3
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000000|1234567"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """rid, doc_id, owner, repo, and for each kind its matches and the lengths of the stretches between them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"),
        text.alias("text"),
    )
    base = base.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()))
    gaps = [F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), F.length)).alias(f"g_{k}") for k, p in PATTERNS.items()]
    values = F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("v_assign")
    return base.select("rid", "doc_id", "owner", "repo", *(f"m_{k}" for k in KINDS), *gaps, values)


def candidates(scanned: DataFrame) -> DataFrame:
    """rid, owner, repo, kind (its number), start, end, value: one row for each match that is long enough."""
    rows = None
    for i, k in enumerate(KINDS):
        value = F.col("v_assign") if k == "assign" else F.col(f"m_{k}")
        some = scanned.where(F.size(f"m_{k}") > 0).select("rid", "owner", "repo", F.lit(i).alias("kind"), F.posexplode(F.arrays_zip(F.transform(f"m_{k}", F.length).alias("n"), F.slice(f"g_{k}", 1, F.size(f"m_{k}")).alias("gap"), value.alias("value"))).alias("at", "x"))
        rows = some if rows is None else rows.unionByName(some)
    before = F.sum(F.col("x.gap") + F.col("x.n")).over(Window.partitionBy("rid", "kind").orderBy("at"))
    placed = rows.select("rid", "owner", "repo", "kind", (before - F.col("x.n")).alias("start"), before.alias("end"), F.col("x.value").alias("value"))
    return placed.where((F.col("kind") != KINDS.index("assign")) | (F.length("value") >= 12))


def ownership(cands: DataFrame) -> DataFrame:
    """hash, n_rows, n_repos, n_owners of every value."""
    by_repo = cands.groupBy(F.sha2("value", 256).alias("hash"), "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def judge(cands: DataFrame, scratch: Scratch, max_owners: int = 2) -> DataFrame:
    """The candidates, a saved table, with n_repos, n_owners, live and kept."""
    stats = scratch.save(ownership(cands), "owners")
    live = (F.col("n_owners") <= max_owners) & ~F.col("value").rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split("value", ""))) >= 6)
    judged = join_facts(cands.withColumn("hash", F.sha2("value", 256)), stats, ["hash"], "n_rows").withColumn("live", live)
    return judged.withColumn("kept", (F.col("kind") < BASE) | F.col("live"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat(F.get(names, c["kind"]), F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))), ",")


def find(df: DataFrame, scratch: Scratch, max_owners: int = 2, **columns: str) -> DataFrame:
    """rid, doc_id and spans (start, kind, end, n_repos, n_owners, live), in order, for every row of df."""
    scanned = scratch.save(scan(df, **columns), "scan")
    cands = scratch.save(candidates(scanned), "candidates")
    spans = judge(cands, scratch, max_owners).where("kept").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "kind", F.col("end").cast("int").alias("end"), "n_repos", "n_owners", "live"))).alias("spans"))
    return scanned.select("rid", "doc_id").join(spans, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def redact(df: DataFrame, scratch: Scratch, mark: str = "[SECRET]", max_owners: int = 2, text_col: str = "text") -> DataFrame:
    """df with each live-looking secret of its text replaced; overlapping ones become one mark. Examples stay.

    A null text stays null. Other columns stay as they are, whatever their names.
    """
    row, held = clear_name(df, "row"), clear_name(df, "live")
    rows = numbered(df, row, scratch)
    found = find(rows, scratch, max_owners, id_col=row, text_col=text_col)
    live = found.select(F.col("doc_id").alias(row), F.filter("spans", lambda c: c["live"]).alias(held)).where(F.size(held) > 0)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        gap = F.concat(acc["text"], F.col(text_col).substr(acc["at"] + 1, c["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(c["start"] >= acc["at"], gap).otherwise(acc["text"]).alias("text"), F.greatest(acc["at"], c["end"]).alias("at"))

    end = lambda acc: F.concat(acc["text"], F.col(text_col).substr(acc["at"] + 1, F.length(text_col)))
    marked = rows.join(live, row, "left")
    text = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(F.aggregate(held, start, step, end))
    return marked.withColumn(text_col, text).select(*df.columns)


def op5_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    base = F.filter("spans", lambda c: c["kind"] < BASE)
    number = lambda i: F.size(F.filter("spans", lambda c: c["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    counts = [number(i) for i in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda c: c["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda c: ~c["live"])).cast("long").alias("n_shared"))
