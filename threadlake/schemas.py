"""Table layouts. Epoch seconds are BIGINT, raw records stay whole in ``archive_json``."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _layout(*columns: tuple[str, type]) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns])


# Names and order of the stored columns.
POSTS = _layout(
    ("id", StringType),
    ("subreddit", StringType),
    ("created_utc", LongType),
    ("author", StringType),
    ("title", StringType),
    ("permalink", StringType),
    ("url", StringType),
    ("score", LongType),
    ("num_comments", LongType),
    ("is_self", IntegerType),
    ("archive_json", StringType),
    ("live_score", LongType),
    ("live_num_comments", LongType),
    ("live_refreshed_at", LongType),
    ("fetched_at", LongType),
)

COMMENTS = _layout(
    ("id", StringType),
    ("link_id", StringType),
    ("parent_id", StringType),
    ("subreddit", StringType),
    ("created_utc", LongType),
    ("author", StringType),
    ("score", LongType),
    ("body", StringType),
    ("archive_json", StringType),
    ("fetched_at", LongType),
)

COMMENT_TREES = _layout(
    ("link_id", StringType),
    ("subreddit", StringType),
    ("tree_json", StringType),
    ("fetched_at", LongType),
)

THREAD_LINES = _layout(
    ("community", StringType),
    ("link_id", StringType),
    ("subreddit", StringType),
    ("pos", LongType),
    ("text", StringType),
)

THREAD_POSTS = _layout(
    ("community", StringType),
    ("link_id", StringType),
    ("subreddit", StringType),
    ("comments", LongType),
    ("in_tree", LongType),
)

SUBREDDIT_META = _layout(
    ("subreddit", StringType),
    ("subscribers", LongType),
    ("created_utc", LongType),
    ("public_description", StringType),
    ("meta_json", StringType),
    ("fetched_at", LongType),
)

COVERED = _layout(
    ("subreddit", StringType),
    ("kind", StringType),
    ("since", LongType),
    ("until", LongType),
    ("updated_at", LongType),
)

REQUESTS = _layout(
    ("subreddit", StringType),
    ("kind", StringType),
    ("since", LongType),
    ("before", LongType),
)

# CSV exports carry the scalar columns only.
_NOT_IN_CSV = ("archive_json", "fetched_at")
POST_CSV = [name for name in POSTS.names if name not in _NOT_IN_CSV]
COMMENT_CSV = [name for name in COMMENTS.names if name not in _NOT_IN_CSV]
