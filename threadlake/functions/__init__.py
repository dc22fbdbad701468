"""Column functions: every scalar rule of the engine as a native Spark expression."""

from .html import attribute_of, opening_tags, tag_attribute, with_attributes
from .json_text import drop_json_field, json_default, json_quote
from .lines import line_problem
from .names import parent_kind, split_list, strip_fullname
from .numbers import CountText, int_or_zero, parse_count, to_bigint, truthy
from .times import (
    ARCHIVE_EPOCH,
    epoch_date,
    epoch_of_ntz,
    month_of_epoch,
    parse_timespec,
    window_days,
)

__all__ = [
    "ARCHIVE_EPOCH",
    "CountText",
    "attribute_of",
    "drop_json_field",
    "epoch_date",
    "epoch_of_ntz",
    "int_or_zero",
    "json_default",
    "json_quote",
    "line_problem",
    "month_of_epoch",
    "opening_tags",
    "parent_kind",
    "parse_count",
    "parse_timespec",
    "split_list",
    "strip_fullname",
    "tag_attribute",
    "to_bigint",
    "truthy",
    "window_days",
    "with_attributes",
]
