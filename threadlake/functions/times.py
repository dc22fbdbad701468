"""Epoch-second time rules. All are UTC whatever the session time zone; ``now`` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column, as_literal

# Start of the archive and seconds per unit of a relative spec.
ARCHIVE_EPOCH = 1119225600
UNIT_SECONDS = {"y": 31536000, "m": 2592000, "d": 86400, "h": 3600}

DAY = 86400
MAX_EPOCH = 253402300800  # start of the year 10000: no record is as late


def _floor_div(value: Column, by: int) -> Column:
    by_col = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, by_col), by_col)


def parse_timespec(spec: Column | str, now, is_since) -> Column:
    """Epoch second named by a human time spec; NULL when it cannot be understood.

    NULL and ``all`` mean the archive start (as a start) or now (as an end).
    """
    raw = as_column(spec)
    now, since = as_literal(now).cast("bigint"), as_literal(is_since)
    text = F.lower(F.trim(raw))
    open_end = F.when(since, F.lit(ARCHIVE_EPOCH).cast("bigint")).otherwise(now)

    # Fixed value: a relative time is a number and a unit.
    relative = r"^(\d+)\s*([ymdh])$"
    amount = F.regexp_extract(text, relative, 1).try_cast("bigint")
    unit = F.regexp_extract(text, relative, 2)
    seconds = F.lit(None).cast("bigint")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(size).cast("bigint")).otherwise(seconds)
    ago = F.call_function("try_subtract", now, F.call_function("try_multiply", amount, seconds))

    day = F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & ~text.startswith("0000"),
        F.unix_date(F.call_function("try_to_date", text, F.lit("y-M-d"))),
    )
    return (
        F.when(raw.isNull() | (text == "all"), open_end)
        .when(text == "now", now)
        .when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
        .when(text.rlike(relative), ago)
        .otherwise(day.cast("bigint") * DAY)
    )


def window_days(since: Column | str, until: Column | str) -> Column:
    return _floor_div(as_column(until) - as_column(since), DAY)


def epoch_date(epoch: Column | str) -> Column:
    """``YYYY-MM-DD`` of an epoch second."""
    days = _floor_div(as_column(epoch), DAY).cast("int")
    return F.date_from_unix_date(days).cast("string")


def month_of_epoch(epoch: Column | str) -> Column:
    """Months since 1970-01, as an INT: the layout and join bucket of the archive.

    NULL where the day is beyond INT, as for a time in microseconds.
    """
    date = F.date_from_unix_date(_floor_div(as_column(epoch), DAY).try_cast("int"))
    return ((F.year(date) - 1970) * 12 + F.month(date) - 1).cast("int")


def epoch_of_ntz(ts: Column | str) -> Column:
    """Epoch second of a zone-less timestamp read as UTC."""
    c = as_column(ts)
    return (
        F.unix_date(c.cast("date")).cast("bigint") * DAY
        + F.hour(c) * 3600
        + F.minute(c) * 60
        + F.second(c)
    )
