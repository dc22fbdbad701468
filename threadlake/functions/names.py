"""Fullname handling (``t3_<post>``, ``t1_<comment>``) and name lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column

# Fullname prefixes of the record kinds.
POST_KIND = "t3"
COMMENT_KIND = "t1"


def strip_fullname(name: Column | str) -> Column:
    """Bare id after the first underscore; NULL and '' give NULL."""
    c = as_column(name)
    return F.when(c != "", c.substr(F.locate("_", c) + 1, F.length(c)))


def parent_kind(parent_id: Column | str) -> Column:
    """Prefix before the first underscore; NULL reads as ''."""
    return F.substring_index(F.coalesce(as_column(parent_id), F.lit("")), "_", 1)


def split_list(names: Column | str) -> Column:
    """Comma list to an array of trimmed, non-empty names."""
    parts = F.transform(F.split(as_column(names), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")
