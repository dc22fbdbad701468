"""What is shuffled, and that shuffle files go."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from threadlake.plans import fixtures as fx
from threadlake.scratch import write_table

LINE = (
    "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz"
)


def lines(spark, folder):
    """Order 7 has three copies of its line 1; order 8 is nobody's, and one line has no number."""
    day = lambda n: datetime(1997, 1, n)
    rows = [(7, 1, 5, 9, 3.0, 1.0, 0.0, 0.0, "N", "O", day(d)) for d in (3, 2, 4)]
    rows += [(7, 2, 5, 9, 3.0, 1.0, 0.0, 0.0, "N", "O", day(5)), (8, 1, 5, 9, 3.0, 1.0, 0.0, 0.0, "N", "O", day(1))]
    rows += [(7, None, 5, 9, 3.0, 1.0, 0.0, 0.0, "N", "O", day(1))]
    spark.createDataFrame(rows, LINE).write.parquet(f"{folder}/lineitem.parquet")
    orders = spark.createDataFrame([(7, "2-HIGH", 31)], "o_orderkey bigint, o_orderpriority string, o_custkey bigint")
    orders.write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_the_first_copy_of_a_line_is_the_comment(spark, tmp_path):
    found = fx.comments(spark, lines(spark, tmp_path)).select("id", "created_utc", "custkey").collect()
    second, fifth = 852163200, 852422400  # of January 1997
    assert sorted(map(tuple, found)) == [("7-1", second, 31), ("7-2", fifth, 31)]


def test_copies_are_told_apart_before_their_texts_are_made(spark, tmp_path):
    df = fx.comments(spark, lines(spark, tmp_path)).select("id", "archive_json")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS archive_json") < plan.index("row_number")  # printed from the top


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before = spark.conf.get(key)
    table = write_table(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "test")
    assert spark.conf.get(key) == set_before
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert table.count() == 7
