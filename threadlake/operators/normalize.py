"""Landed JSON text to typed rows. Each record is parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake import schemas
from threadlake.functions import int_or_zero, line_problem, to_bigint, truthy
from threadlake.functions._columns import as_column, as_literal

_POST = (
    "id string, subreddit string, created_utc string, author string, title string, "
    "permalink string, url string, score string, num_comments string, is_self variant"
)
_COMMENT = (
    "id string, link_id string, parent_id string, subreddit string, created_utc string, "
    "author string, score string, body string"
)
_META = "display_name string, subscribers string, created_utc string, public_description string"


def _parsed(raw: DataFrame, value: str, layout: str) -> DataFrame:
    # As a generator: later filters on parsed fields would otherwise move below the projection
    # and parse every record once more.
    return raw.select("*", F.explode(F.array(F.from_json(value, layout))).alias("_r"))


def with_problem(rows: DataFrame, raw_time: str = "_time") -> DataFrame:
    """Rows that kept ``raw_time``, with the reason why no window holds them in its place."""
    problem = line_problem("archive_json", raw_time, "subreddit")
    return rows.withColumn("problem", problem).drop(raw_time)


def _or_default(text: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), default)


def normalize_posts(
    raw: DataFrame,
    default_subreddit: str | Column,
    fetched_at,
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Posts rows; ``keep`` names columns of ``raw`` to carry along (arrival order). ``_time`` among
    them is the time as the record has it."""
    r = F.col("_r")
    nothing = F.lit(None).cast("bigint")
    columns = {
        "id": r["id"],
        "subreddit": _or_default(r["subreddit"], as_column(default_subreddit)),
        "created_utc": int_or_zero(r["created_utc"]),
        "author": r["author"],
        "title": r["title"],
        "permalink": r["permalink"],
        "url": r["url"],
        "score": to_bigint(r["score"]),
        "num_comments": to_bigint(r["num_comments"]),
        "is_self": truthy(r["is_self"]),
        "archive_json": F.col(value),
        "live_score": nothing,
        "live_num_comments": nothing,
        "live_refreshed_at": nothing,
        "fetched_at": as_literal(fetched_at).cast("bigint"),
    }
    return _select(_parsed(raw, value, _POST), schemas.POSTS, columns, keep)


def normalize_comments(
    raw: DataFrame,
    default_subreddit: str | Column,
    fetched_at,
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    r = F.col("_r")
    columns = {
        "id": r["id"],
        "link_id": r["link_id"],
        "parent_id": r["parent_id"],
        "subreddit": _or_default(r["subreddit"], as_column(default_subreddit)),
        "created_utc": int_or_zero(r["created_utc"]),
        "author": r["author"],
        "score": to_bigint(r["score"]),
        "body": r["body"],
        "archive_json": F.col(value),
        "fetched_at": as_literal(fetched_at).cast("bigint"),
    }
    return _select(_parsed(raw, value, _COMMENT), schemas.COMMENTS, columns, keep)


def normalize_meta(
    raw: DataFrame,
    subreddit: str | Column,
    fetched_at,
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    r = F.col("_r")
    created = int_or_zero(r["created_utc"])
    columns = {
        "subreddit": as_column(subreddit),
        "subscribers": to_bigint(r["subscribers"]),
        "created_utc": F.when(created != 0, created),
        "public_description": r["public_description"],
        "meta_json": F.col(value),
        "fetched_at": as_literal(fetched_at).cast("bigint"),
    }
    return _select(_parsed(raw, value, _META), schemas.SUBREDDIT_META, columns, keep)


def _select(df, layout, columns: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    kept = [F.col("_r.created_utc").alias(c) if c == "_time" else F.col(c) for c in keep]
    return df.select(*[columns[f.name].alias(f.name) for f in layout], *kept)
