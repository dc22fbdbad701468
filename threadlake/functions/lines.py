"""Can a landed line be placed in a window, and if not, why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column
from .numbers import int_or_zero, to_bigint
from .times import MAX_EPOCH


def line_problem(value: Column | str, time: Column | str, community: Column | str) -> Column:
    """``no json``, ``no time``, ``time out of range`` or ``no community``; NULL for all other lines.

    ``time`` is the text of the record's own time, read as stored rows read it.
    """
    time = as_column(time)
    unread = to_bigint(time).isNull()
    # Infinite and NaN times are none; finite ones beyond BIGINT are out of range.
    finite = F.coalesce(F.abs(time.try_cast("double")) < float("inf"), F.lit(False))
    no_time = unread & ~finite
    return (
        F.when(no_time & F.get_json_object(as_column(value), "$").isNull(), "no json")
        .when(no_time, "no time")
        .when(unread | ~int_or_zero(time).between(0, MAX_EPOCH - 1), "time out of range")
        .when(F.coalesce(as_column(community), F.lit("")) == "", "no community")
    )
