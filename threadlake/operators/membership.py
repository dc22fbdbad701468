"""Which records does the store already hold: semi and anti joins on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def existing_ids(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct ids of ``batch`` that are in ``store`` (whose ids are unique).

    The batch ids are made distinct before the join, so copies of one id meet as one row. A
    batch small enough is broadcast by Spark, and the store is then only scanned for its ids.
    """
    asked = batch.select("id").distinct()
    return store.select("id").join(asked, "id", "left_semi")


def absent_from(batch: DataFrame, store: DataFrame, probe: bool = False) -> DataFrame:
    """Rows of ``batch`` whose id is not in ``store``.

    ``probe=True`` suits a written batch that is small beside the store: the store's matching
    ids are found first (without shuffling the store when the batch can be broadcast) and only
    those are anti joined.
    """
    known = existing_ids(batch, store) if probe else store.select("id")
    return batch.join(known, "id", "left_anti")


def missing_trees(posts: DataFrame, trees: DataFrame) -> DataFrame:
    """Posts that have no stored tree yet, oldest first."""
    having = trees.select(F.col("link_id").alias("id"))
    return (
        posts.select("id", "subreddit", "created_utc")
        .join(having, "id", "left_anti")
        .orderBy("created_utc", "id")
    )


def tree_flags(posts: DataFrame, trees: DataFrame) -> DataFrame:
    """Does each post have a stored tree."""
    having = trees.select(F.col("link_id").alias("id"), F.lit(True).alias("has_tree"))
    return posts.join(having, "id", "left").withColumn(
        "has_tree", F.coalesce("has_tree", F.lit(False))
    )
