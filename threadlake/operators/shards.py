"""Equal time slices of a window, record to slice, and pages in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions._columns import as_column, as_literal
from threadlake.scratch import write_table

from .skew import HOT_ROWS, rank_in_groups


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _slices(since: Column, before: Column, n: Column) -> Column:
    single = (n <= 1) | (before <= since)
    return F.when(single, F.lit(1)).otherwise(n).cast("bigint")


def shard_bounds(windows: DataFrame, n: str = "n") -> DataFrame:
    """Contiguous slices of each [since, before); the last one takes the remainder."""
    since, before = F.col("since"), F.col("before")
    count = _slices(since, before, F.col(n))
    i = F.col("shard")
    rows = windows.withColumn("_slices", count).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    )
    step = _div(before - since, F.col("_slices"))
    last = i == F.col("_slices") - 1
    return rows.select(
        *[c for c in windows.columns if c not in ("since", "before", n)],
        "shard",
        (since + i * step).alias("start"),
        F.when(last, before).otherwise(since + (i + 1) * step).alias("end"),
    )


def shard_of(created: Column | str, since, before, n) -> Column:
    """Slice number of a record; NULL outside the window."""
    t = as_column(created)
    since, before = as_literal(since).cast("bigint"), as_literal(before).cast("bigint")
    count = _slices(since, before, as_literal(n))
    step = _div(before - since, count)
    slot = F.when(step == 0, count - 1).otherwise(
        F.least(_div(t - since, F.greatest(step, F.lit(1))), count - 1)
    )
    return F.when((t >= since) & (t < before), slot)


def keyset_pages(records: DataFrame, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pages of ``limit`` records per community, whatever its case, in (created_utc, id) order.

    ``full_seconds`` counts the seconds ending in the page that hold more records than a page,
    which a cursor that only remembers the last second could not step through.
    """
    keyed = write_table(records.select(F.lower("subreddit").alias("subreddit"), "created_utc", "id"), "pages")
    ranked = rank_in_groups(keyed, ["subreddit"], ["created_utc", "id"], "_rn", hot_rows)
    size = F.lit(limit).cast("bigint")
    paged = ranked.withColumn("page", _div(F.col("_rn") - 1, size))
    # Counted per second first: both results below read this one exchange.
    seconds = paged.groupBy("subreddit", "page", "created_utc").agg(F.count("*").alias("_n"))
    pages = seconds.groupBy("subreddit", "page").agg(
        F.sum("_n").alias("n_rows"), F.max("created_utc").alias("last_created_utc")
    )
    crowded = (
        seconds.groupBy("subreddit", "created_utc")
        .agg(F.sum("_n").alias("_n"), F.max("page").alias("page"))
        .where(F.col("_n") > limit)
        .groupBy("subreddit", "page")
        .agg(F.count("*").alias("_full"))
    )
    return pages.join(crowded, ["subreddit", "page"], "left").select(
        "subreddit",
        "page",
        "n_rows",
        "last_created_utc",
        (F.col("n_rows") < limit).alias("is_short"),
        F.coalesce("_full", F.lit(0).cast("bigint")).alias("full_seconds"),
    )
