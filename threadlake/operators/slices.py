"""A window cut into slices of like size, from a histogram of its days.

Equal times (``shards``) make unequal slices where a community has grown. Here a first pass counts
records per day, which is as many rows as the window has days, and each slice takes days until it
holds its share. Days are whole, so a slice is off by at most one day's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86400


def _day(time: str) -> Column:
    second = F.col(time).cast("bigint")
    return F.call_function("div", second - F.pmod(second, F.lit(DAY).cast("bigint")), F.lit(DAY).cast("bigint"))


def slice_plan(records: DataFrame, since: int, before: int, n: int) -> DataFrame:
    """Slices of ``[since, before)``: (slice, start, end, n_rows), at most ``n``, none without rows.

    They cover the window without gaps: a slice ends where the next one starts.
    """
    inside = records.where((F.col("created_utc") >= since) & (F.col("created_utc") < before))
    days = inside.groupBy(_day("created_utc").alias("day")).agg(F.count("*").alias("n_rows"))
    # One row per day of the window: a bounded table, whatever the records are.
    ordered = Window.partitionBy(F.lit(0)).orderBy("day")
    so_far = F.sum("n_rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))
    share = F.call_function("div", (so_far - F.col("n_rows")) * F.lit(n), total)
    sliced = days.withColumn("_share", share).groupBy("_share").agg(
        F.min("day").alias("day"), F.sum("n_rows").alias("n_rows")
    )
    by_day = Window.partitionBy(F.lit(0)).orderBy("day")
    start = F.when(F.row_number().over(by_day) == 1, F.lit(since)).otherwise(F.col("day") * DAY)
    return sliced.withColumn("start", start.cast("bigint")).select(
        (F.row_number().over(by_day) - 1).cast("bigint").alias("slice"),
        "start",
        F.coalesce(F.lead("start").over(by_day), F.lit(before)).cast("bigint").alias("end"),
        "n_rows",
    )


def slice_of(time: Column | str, plan: list[tuple[int, int, int]]) -> Column:
    """Number of the slice (slice, start, end) that holds a time; NULL outside all of them."""
    t = F.col(time) if isinstance(time, str) else time
    if not plan:
        return F.lit(None).cast("bigint")
    starts = F.array(*[F.lit(start).cast("bigint") for _, start, _ in plan])
    inside = (t >= plan[0][1]) & (t < plan[-1][2])
    return F.when(inside, F.size(F.filter(starts, lambda s: s <= t)).cast("bigint") - 1)
