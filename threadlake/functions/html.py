"""Attributes of the first element of given tags in a landed page.

One pass over the page finds the opening tags asked for (``opening_tags``); attributes are then read
from these short texts, however many are asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import as_column

# Markup whose content is text, not elements.
_INERT = r"<!--.*?-->|<(?:script|style|textarea|title)\b[^>]*+>.*?</(?:script|style|textarea|title)\s*+>"
# One attribute: name, then its value in either quote style, bare or absent.
_ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?"""


def opening_tags(html: Column | str, *tags: str) -> Column:
    """Opening tags of these elements in page order, without their brackets.

    The quantifiers are possessive, so a page cannot make the match backtrack.
    """
    names = "|".join(re.escape(t) for t in tags)
    opening = rf"""<((?:{names})(?:[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+)?)>"""
    found = F.regexp_extract_all(as_column(html), F.lit(f"(?is){_INERT}|{opening}"), F.lit(1))
    return F.filter(found, lambda tag: tag != "")


def attribute_of(tags: Column | str, tag: str, attribute: str) -> Column:
    """Value of an attribute of the first ``tag`` among ``opening_tags`` ('' when it has none); NULL
    without the element or attribute. Either quote style, any attribute order."""
    is_tag = rf"(?is)^{re.escape(tag)}(?:[\s/].*)?\z"
    attrs = F.get(F.filter(as_column(tags), lambda t: t.rlike(is_tag)), F.lit(0)).substr(
        F.lit(len(tag) + 1), F.lit(1 << 30)
    )
    names = F.transform(F.regexp_extract_all(attrs, F.lit(_ATTRIBUTE), F.lit(1)), lambda x: F.lower(x))
    place = F.array_position(names, attribute.lower()).cast("int")
    texts = [
        F.get(F.regexp_extract_all(attrs, F.lit(_ATTRIBUTE), F.lit(i)), place - 1)
        for i in (2, 3, 4)
    ]
    return F.when(place > 0, F.concat(*texts))


def tag_attribute(html: Column | str, tag: str, attribute: str) -> Column:
    """One attribute of one element of a page."""
    return attribute_of(opening_tags(html, tag), tag, attribute)


def with_attributes(
    pages: DataFrame, html: str, wanted: dict[str, tuple[str, str]], keep: list[str] | None = None
) -> DataFrame:
    """``pages`` without their text, and with a column for each (tag, attribute) wanted.

    The tags are a generator's output: projections above it cannot repeat the pass over the page.
    """
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    tags = opening_tags(html, *dict.fromkeys(tag for tag, _ in wanted.values()))
    found = pages.select(*keep, F.explode(F.array(tags)).alias("_tags"))
    return found.select(
        *keep, *[attribute_of("_tags", tag, name).alias(out) for out, (tag, name) in wanted.items()]
    )
