"""Refresh of displayed counts: worklist, outcome of each visited page, merge on to posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import parse_count, with_attributes

from .dedup import last_wins

# The element of a post's page, and its attributes, that show the counts.
PAGE_TAG = "shreddit-post"
PAGE_SCORE = "score"
PAGE_COMMENTS = "comment-count"


def refresh_worklist(
    posts: DataFrame,
    now: int,
    window_days: int,
    base_url: str,
    subreddits: list[str] | DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Posts of the last ``window_days``, newest first; no communities named means all.

    ``subreddits`` may be a table of names when the list is long. ``limit`` 0 or None: no cap.
    """
    work = posts.where(F.col("created_utc") >= now - window_days * 86400)
    if isinstance(subreddits, DataFrame):
        work = work.withColumn("_community", F.lower("subreddit")).join(
            subreddits.select(F.lower("subreddit").alias("_community")).distinct(),
            "_community",
            "left_semi",
        )
    elif subreddits:
        work = work.where(F.lower("subreddit").isin([s.lower() for s in subreddits]))
    work = work.select(
        "id",
        "subreddit",
        "permalink",
        "created_utc",
        F.when(F.col("permalink") != "", F.concat(F.lit(base_url), "permalink")).alias("url"),
    ).orderBy(F.col("created_utc").desc(), F.col("id").desc())
    return work.limit(limit) if limit else work


def page_counts(
    pages: DataFrame,
    tag: str = PAGE_TAG,
    html: str = "html",
    score: str = PAGE_SCORE,
    comments: str = PAGE_COMMENTS,
) -> DataFrame:
    """Count texts shown by each landed page; the page text itself is dropped."""
    return with_attributes(pages, html, {"score_text": (tag, score), "comments_text": (tag, comments)})


def refresh_outcome(worklist: DataFrame, counts: DataFrame) -> DataFrame:
    """Per worklist row: refreshed or failed, and the counts read.

    ``counts`` (id, score_text, comments_text, refreshed_at) may hold several visits of a
    post; the latest counts. Fails: no address, no page, no score, or a broken number. An
    unreadable number is stored as NULL.
    """
    latest = last_wins(counts, ["id"], ["refreshed_at"])
    rows = worklist.select("id", "subreddit", "permalink").join(latest, "id", "left")
    score = parse_count("score_text", signed=True)
    comments = parse_count("comments_text")
    addressed = F.coalesce(F.col("permalink") != "", F.lit(False))
    ok = addressed & F.col("score_text").isNotNull() & ~score.broken & ~comments.broken
    return rows.select(
        "id",
        "subreddit",
        F.when(ok, "refreshed").otherwise("failed").alias("outcome"),
        F.when(ok, score.value).alias("live_score"),
        F.when(ok, comments.value).alias("live_num_comments"),
        F.when(ok, F.col("refreshed_at")).alias("live_refreshed_at"),
    )


def refresh_totals(outcome: DataFrame) -> DataFrame:
    """Refreshed, failed and total per community, and overall (subreddit NULL)."""
    refreshed = F.col("outcome") == "refreshed"
    return outcome.rollup("subreddit").agg(
        F.count_if(refreshed).alias("refreshed"),
        F.count_if(~refreshed).alias("failed"),
        F.count("*").alias("total"),
    )


def merge_live_counts(posts: DataFrame, outcome: DataFrame) -> DataFrame:
    """Posts with the refreshed counts; a read NULL replaces an older number.

    Ids are unique on both sides. Unknown ids change nothing.
    """
    names = ["live_score", "live_num_comments", "live_refreshed_at"]
    new = outcome.where(F.col("outcome") == "refreshed").select(
        "id", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_{n}") for n in names]
    )
    merged = posts.join(new, "id", "left")
    return merged.select(
        *[
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else c
            for c in posts.columns
        ]
    )
