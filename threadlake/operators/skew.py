"""Ranking, neighbours and lookup that stay balanced when one key holds a large share of all rows.

All count rows per key first (partial aggregation on the map side) and treat the keys above
``hot_rows``, at any table size the same number, apart. Their rows are not brought together:

* with at most MAX_HOT_KEYS such keys, the table of these keys is broadcast to tell their rows from
  the others, and only they are dealt by ranges;
* with more, all rows are dealt by ranges.

Dealt by ranges means range partitioned by the key and what orders its rows: a key spreads over as many
tasks as it needs, and one task's part of a key is a group of its own. What the parts have to know
of each other is one row per part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.scratch import write_table

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 20_000

_PARTITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; columns of ``left``, then the rest of ``right``."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def hot_keys(
    df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, rows: int | None = None
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, written, or None.

    ``df`` should be a written table; ``rows`` is its row count where that is known.
    """
    total = df.count() if rows is None else rows
    if total <= hot_rows:
        return None
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = write_table(counted.where(F.col("_n") > hot_rows).select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def split_hot(
    df: DataFrame, hot: DataFrame, keys: list[str], most: int | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys; (None, all rows) if there are too many hot keys
    to tell them apart by a broadcast."""
    if hot.count() > (MAX_HOT_KEYS if most is None else most):
        return None, df
    marked = F.broadcast(hot)
    return (
        _join_null_safe(df, marked, keys, "left_anti"),
        _join_null_safe(df, marked, keys, "left_semi"),
    )


def _dealt_by_ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_place``, its row's place in the order of (group, order), and ``_range``, the
    part it lies in; written, as places must not change."""
    keys = [*group, *order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_table(
        df.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranges",
    ).withColumn("_range", F.shiftright("_place", _PARTITION_BITS))


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, where ``right`` has at most one row per (non-null) key.

    A hot key's row of ``right`` is looked up once for each part the key is dealt to.
    """
    hot = hot_keys(left, keys, hot_rows, rows)
    if hot is None:
        return left.join(right, keys, how)
    cold, warm = split_hot(left, hot, keys)
    joined = _lookup_by_ranges(warm, right, keys, how)
    return joined if cold is None else cold.join(right, keys, how).unionByName(joined)


def _lookup_by_ranges(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    numbered = left.withColumn("_row", F.monotonically_increasing_id())  # splits equal keys
    dealt = _dealt_by_ranges(numbered, keys, ["_row"])
    asked = dealt.select(*keys, "_range").distinct().join(right, keys)
    joined = dealt.join(asked, [*keys, "_range"], how)
    return joined.select(*keys, *[c for c in [*left.columns, *right.columns] if c not in keys])


def rank_in_groups(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str = "rank",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number()`` per group (1, 2, ...); ``order`` must be unique inside a group.

    Ordinary groups use a window. A hot group's row has its place in its part, plus the counts of
    the group's earlier parts. ``df`` should be a written table.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    hot = hot_keys(df, group, hot_rows)
    if hot is None:
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    cold, warm = split_hot(df, hot, group)
    ranked = _rank_by_ranges(warm, group, order, out)
    if cold is None:
        return ranked
    return cold.withColumn(out, F.row_number().over(window).cast("bigint")).unionByName(ranked)


def _rank_by_ranges(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    placed = _dealt_by_ranges(df, group, order)
    runs = placed.groupBy(*group, "_range").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    )
    # At most one row per group and range.
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    runs = runs.withColumn("_before", F.sum("_n").over(earlier) - F.col("_n")).drop("_n")
    joined = _join_null_safe(placed, runs, [*group, "_range"], "inner")
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return joined.select(*df.columns, rank.cast("bigint").alias(out))


def neighbours_in_groups(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """``df`` with ``_before``, the value of the row before in its group (NULL for the first), and
    ``_is_last``. ``value`` is never NULL; ``order`` must be unique inside a group.

    The first and last row of a hot group's part look beyond it by one row per part. ``df`` should
    be a written table.
    """

    def marked(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_before", F.lag(value).over(window)).withColumn(
            "_is_last", F.lead(value).over(window).isNull()
        )

    hot = hot_keys(df, group, hot_rows, rows)
    if hot is None:
        return marked(df, *group)
    cold, warm = split_hot(df, hot, group)
    dealt = _dealt_by_ranges(warm, group, order)
    runs = dealt.groupBy(*group, "_range").agg(F.max_by(value, "_place").alias("_end"))
    by_range = Window.partitionBy(*group).orderBy("_range")
    runs = runs.select(
        *group,
        "_range",
        F.lag("_end").over(by_range).alias("_end_before"),
        F.lead("_end").over(by_range).isNull().alias("_ends_group"),
    )
    inside = _join_null_safe(marked(dealt, *group, "_range"), runs, [*group, "_range"], "inner")
    inside = inside.select(
        *df.columns,
        F.coalesce("_before", "_end_before").alias("_before"),
        (F.col("_is_last") & F.col("_ends_group")).alias("_is_last"),
    )
    return inside if cold is None else marked(cold, *group).unionByName(inside)
