"""What keeps the work and the disk of larger tables down."""

from pyspark.sql import functions as F

from spangrove.operators.grammar_tables import Grammars
from spangrove.sources.scratch import CLEANUP, scratch_save


def test_shuffle_files_go_with_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = disk.getAllFiles().size(), spark.conf.get(CLEANUP, None)
    saved = scratch_save(spark)(spark.range(1000).groupBy(F.col("id") % 7).count(), "x")
    assert disk.getAllFiles().size() <= before and spark.conf.get(CLEANUP, None) == setting
    assert saved.count() == 7


def test_first_elements_stand_after_nothing(spark):
    rows = [(1, "S", "a", 0, "T"), (1, "S", "a", 1, "T"), (1, "T", "b", 0, "x")]
    g = Grammars(spark.createDataFrame(rows, "g long, rule string, alt string, pos int, name string"), ["g"], scratch_save(spark))
    starts = spark.createDataFrame([(1, "S")], "g long, rule string")
    assert {(r.rule, r.token) for r in g.follow(starts).collect()} == {("S", "○"), ("T", "○"), ("T", "x")}
    assert {r.pos for r in g._after(starts).where("node.kind = 'S'").select("node.pos").collect()} == {1}
