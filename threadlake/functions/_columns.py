from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_literal(value) -> Column:
    """Parameters such as ``now`` may be a Python value or a column."""
    return value if isinstance(value, Column) else F.lit(value)
