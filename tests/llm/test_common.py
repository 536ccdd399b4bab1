"""Tables written on the way."""

import time

from pyspark.sql import functions as F
from strandloom.llm import common


def shuffled(spark):
    """Shuffle files on this machine."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (folders.apply(i).getName() for i in range(folders.size())) if f.startswith("shuffle_") and f.endswith(".data")}


def test_tidy_tables_leave_no_shuffle_files(spark):
    rows = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 50).alias("g")).agg(F.count("*").alias("n"))
    before = shuffled(spark)
    got = common.materialise(rows, "tidy", tidy=True)
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert got.count() == 50 and got.agg(F.sum("n")).first()[0] == 5000
    common.materialise(rows, "plain")
    assert shuffled(spark) - before
