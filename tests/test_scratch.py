"""Tables in the shared folder."""

from pyspark.sql import functions as F

from rationale.sources.scratch import stored


def test_stored_tables_leave_no_shuffle_files(spark):
    """the shuffle that a table was written from is deleted with the write, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    table = stored(rows)
    assert tracker.shuffleStatuses().size() <= held
    assert {r.k: r.s for r in table.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)} and spark.conf.get(name, None) == before
