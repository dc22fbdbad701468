"""Job rows (communities, time specs, toggles) to load requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import epoch_date, parse_timespec, split_list, window_days

KINDS = ("posts", "comments", "trees", "meta")


def request_windows(jobs: DataFrame, now: int) -> DataFrame:
    """Resolve ``since_spec`` and ``until_spec``; ``is_valid`` needs both and until > since."""
    resolved = jobs.withColumn("since", parse_timespec("since_spec", now, True)).withColumn(
        "before", parse_timespec("until_spec", now, False)
    )
    valid = F.coalesce(F.col("before") > F.col("since"), F.lit(False))
    return resolved.select(
        "*",
        valid.alias("is_valid"),
        window_days("since", "before").alias("days"),
        epoch_date("since").alias("since_date"),
        epoch_date("before").alias("before_date"),
    )


def expand_requests(jobs: DataFrame, now: int) -> DataFrame:
    """One row per community and wanted kind of every valid job.

    ``jobs``: subreddits (comma list), since_spec, until_spec, and fetch_<kind> per kind.
    """
    wanted = F.array_compact(
        F.array(*[F.when(F.col(f"fetch_{k}"), F.lit(k)) for k in KINDS])
    )
    return (
        request_windows(jobs, now)
        .where("is_valid")
        .select(F.explode(split_list("subreddits")).alias("subreddit"), "*")
        .select("subreddit", F.explode(wanted).alias("kind"), "since", "before")
        .distinct()
    )
