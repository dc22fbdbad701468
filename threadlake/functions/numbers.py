"""Lenient number rules: loose JSON scalars in, strict BIGINT out, never an ANSI error."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column


def to_bigint(value: Column | str) -> Column:
    """Integer value of a numeric text (fractions truncate); NULL if not numeric."""
    return as_column(value).try_cast("decimal(38,6)").try_cast("bigint")


def int_or_zero(value: Column | str) -> Column:
    """Missing, empty, false and unreadable values count as 0; true as 1."""
    c = as_column(value)
    return F.when(F.lower(c) == "true", F.lit(1).cast("bigint")).otherwise(
        F.coalesce(to_bigint(c), F.lit(0).cast("bigint"))
    )


def truthy(value: Column | str) -> Column:
    """1 if a JSON value (VARIANT) is true, non-zero or non-empty, otherwise 0."""
    v = as_column(value)
    kind = F.schema_of_variant(v)
    filled = (
        F.when(v.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0)
    )
    return F.coalesce(filled, F.lit(False)).cast("int")


class CountText(NamedTuple):
    """A displayed count: its value, and whether reading it is an error."""

    value: Column
    broken: Column


def parse_count(text: Column | str, signed: bool = False) -> CountText:
    """Plain digits only (``1.2k``, blanks, line breaks and '' give NULL).

    A text that looks like a number but is none (``--5``, or beyond BIGINT) is broken:
    the refresh of its row fails instead of storing NULL.
    """
    c = as_column(text)
    looks_numeric = c.rlike(r"^-*[0-9]+\z" if signed else r"^[0-9]+\z")
    value = F.when(looks_numeric, c.try_cast("bigint"))
    return CountText(value, F.coalesce(looks_numeric & value.isNull(), F.lit(False)))
