"""Records of a window laid out by slice, so that one slice is read from its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.slices import slice_of, slice_plan


def write_slices(records: DataFrame, path: str, since: int, before: int, n: int) -> DataFrame:
    """Write the records of ``[since, before)`` below ``path/slice=<i>``; returns the plan, which lies
    beside them. Each slice is sorted by time and spread over as many files as Spark makes of it.

    ``n`` is a parameter of the caller, so the plan is a short list.
    """
    spark = records.sparkSession
    slice_plan(records, since, before, n).write.mode("overwrite").parquet(f"{path}/plan")
    plan = spark.read.parquet(f"{path}/plan")
    rows = [(r.slice, r.start, r.end) for r in plan.orderBy("slice").collect()]
    placed = records.withColumn("slice", slice_of("created_utc", rows)).where(F.col("slice").isNotNull())
    order = ["slice", "created_utc", "id"]
    (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy("slice")
        .parquet(f"{path}/rows")
    )
    return plan


def read_slice(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The records of one slice, oldest first within each file; other slices' files are not opened."""
    return spark.read.parquet(f"{path}/rows").where(F.col("slice") == number).drop("slice")
