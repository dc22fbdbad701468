"""First-wins and last-wins per key.

``row_number() = 1`` lets Spark keep one row per key on the map side before the shuffle
(WindowGroupLimit), so an id with very many copies sends one row per task, not all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return reduce(lambda rows, key: rows.where(F.col(key).isNotNull()), keys, df)


def first_wins(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The earliest row per key. Rows with a NULL key are no copies of each other: see
    ``without_id``."""
    return _first_row(_with_keys(df, keys), keys, [F.col(c).asc() for c in arrival])


def last_wins(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    return _first_row(_with_keys(df, keys), keys, [F.col(c).desc() for c in arrival])


def without_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows set aside because they have no id."""
    return df.where(F.col(key).isNull())
