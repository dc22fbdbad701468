"""Counts. Partial aggregation runs before every shuffle, so a huge community is no hot spot.

Communities count as one whatever their case, under the lower-case name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_ROWS, lookup

TABLES = ("posts", "comments", "comment_trees")


def _tagged(**tables: DataFrame) -> DataFrame:
    rows = None
    for name in TABLES:
        part = tables[name].select(F.lower("subreddit").alias("subreddit"), F.lit(name).alias("_table"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _counts() -> list:
    return [F.count_if(F.col("_table") == name).alias(name) for name in TABLES]


def stats_overall(posts: DataFrame, comments: DataFrame, trees: DataFrame) -> DataFrame:
    return _tagged(posts=posts, comments=comments, comment_trees=trees).agg(*_counts())


def stats_by_subreddit(posts: DataFrame, comments: DataFrame, trees: DataFrame) -> DataFrame:
    return (
        _tagged(posts=posts, comments=comments, comment_trees=trees)
        .groupBy("subreddit")
        .agg(*_counts())
    )


def stats_rollup(posts: DataFrame, comments: DataFrame, trees: DataFrame) -> DataFrame:
    """Per community and overall in one pass; ``is_overall`` = 1 marks the total."""
    return (
        _tagged(posts=posts, comments=comments, comment_trees=trees)
        .rollup("subreddit")
        .agg(F.grouping("subreddit").cast("int").alias("is_overall"), *_counts())
    )


def ingest_report(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Per (community, kind): records fetched (with an id or without), distinct ids, and ids new to
    the store.

    ``store`` holds (kind, id). Copies of an id are counted before they are shuffled; an id that
    comes under two communities counts in both.
    """
    per_id = batch.groupBy("kind", "id", F.lower("subreddit").alias("subreddit")).agg(F.count("*").alias("_n"))
    known = store.select("kind", "id", F.lit(True).alias("_known"))
    return (
        per_id.join(known, ["kind", "id"], "left")
        .groupBy("subreddit", "kind")
        .agg(
            F.sum("_n").alias("fetched"),
            F.count("id").alias("distinct_ids"),
            F.count_if(F.col("_known").isNull() & F.col("id").isNotNull()).alias("new_rows"),
        )
    )


def csv_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Rows each export of a community holds."""
    return (
        posts.select("subreddit", F.lit("posts").alias("export"))
        .unionAll(comments.select("subreddit", F.lit("comments").alias("export")))
        .groupBy(F.lower("subreddit").alias("subreddit"), "export")
        .agg(F.count("*").alias("n_rows"))
    )


def late_records(records: DataFrame, covered: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records older than the end of their cover (one per community): a tail run never revisits
    them."""
    ends = covered.groupBy(F.lower("subreddit").alias("_community")).agg(F.max("until").alias("_until"))
    keyed = records.withColumn("_community", F.lower("subreddit"))
    matched = lookup(keyed, ends, ["_community"], "inner", hot_rows)
    return matched.where(F.col("created_utc") < F.col("_until")).drop("_community")
