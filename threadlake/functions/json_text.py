"""JSON kept as text: lookups with defaults, quoting, and cutting out one field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import as_column, as_literal

# A JSON text as a row of tokens that leaves nothing out: strings, keys with their colon, brackets,
# commas with the blanks behind them, and what lies between.
_TOKENS = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|[\[\]{}]|,\s*+|[^"\[\]{},]++|"'


def json_default(doc: Column | str, path: str, default) -> Column:
    """Value at a dotted path; the default when a step is missing or no object.

    A JSON null that is really there stays NULL, as a present key does.
    """
    steps = path.split(".")
    doc = as_column(doc)
    parent = F.get_json_object(doc, "$" + "".join(f"['{s}']" for s in steps[:-1]))
    present = F.array_contains(F.json_object_keys(parent), steps[-1])
    value = F.get_json_object(doc, "$" + "".join(f"['{s}']" for s in steps))
    return F.when(present, value).otherwise(as_literal(default))


def json_quote(text: Column | str) -> Column:
    """A string as a JSON string literal; other characters than quotes and controls stay."""
    listed = F.to_json(F.array(as_column(text)))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _field_places(doc: Column, field: str) -> Column:
    """Where a field of the outermost object begins and ends: (start, end) pairs of characters.

    A pass over the tokens that remembers the depth, the last comma at depth 1 and where the field in
    hand began. The field goes with the comma before it or, if it is the first one, with the comma
    behind it.
    """
    state = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("depth"),
        F.lit(-1).alias("comma"),
        F.lit(-1).alias("start"),
        F.array().cast("array<struct<start:int,end:int>>").alias("found"),
    )

    def step(s: Column, token: Column) -> Column:
        at, outer, first = s["at"], s["depth"] == 1, s["comma"] < 0
        after = at + F.length(token)
        comma = outer & token.startswith(",")
        ends = outer & (s["start"] >= 0) & (token.startswith(",") | (token == "}"))
        takes_comma = ends & first & comma
        cut = F.struct(s["start"].alias("start"), F.when(takes_comma, after).otherwise(at).alias("end"))
        begins = outer & token.startswith(f'"{field}"') & token.endswith(":")
        return F.struct(
            after.alias("at"),
            F.when(token.isin("{", "["), s["depth"] + 1)
            .when(token.isin("}", "]"), s["depth"] - 1)
            .otherwise(s["depth"])
            .alias("depth"),
            F.when(comma & ~takes_comma, at).otherwise(s["comma"]).alias("comma"),
            F.when(begins, F.when(first, at).otherwise(s["comma"])).when(ends, -1).otherwise(s["start"]).alias("start"),
            F.when(ends, F.concat(s["found"], F.array(cut))).otherwise(s["found"]).alias("found"),
        )

    tokens = F.regexp_extract_all(doc, F.lit(_TOKENS), F.lit(0))
    return F.aggregate(tokens, state, step, lambda s: s["found"])


def drop_json_field(doc: Column | str, field: str) -> Column:
    """The same text without one field of the outermost object; every other character stays.

    A key is found as it is usually written: spelled with escapes it is another one. Documents that
    do not mention the field are not scanned.
    """
    doc = as_column(doc)
    places = _field_places(doc, field)
    end = F.struct(F.length(doc).alias("start"), F.lit(0).alias("end"))
    kept = F.aggregate(
        F.concat(places, F.array(end)),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, p: F.struct(
            F.concat(s["text"], doc.substr(s["at"] + 1, p["start"] - s["at"])).alias("text"), p["end"].alias("at")
        ),
        lambda s: s["text"],
    )
    return F.when(doc.contains(f'"{field}"'), kept).otherwise(doc)
