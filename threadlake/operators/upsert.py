"""Keyed merges. Plain Parquet has no MERGE, so each returns the rows to append or the new
snapshot of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_wins, last_wins
from .membership import absent_from


def fresh_records(
    batch: DataFrame, store: DataFrame, arrival: list[str], probe: bool = False
) -> DataFrame:
    """First copy of every id of the batch that the store does not hold: the rows to append."""
    return absent_from(first_wins(batch, ["id"], arrival), store, probe)


def upsert(store: DataFrame, batch: DataFrame, arrival: list[str]) -> DataFrame:
    """Snapshot after an insert that leaves stored ids untouched."""
    fresh = fresh_records(batch, store, arrival)
    return store.unionByName(fresh.select(*store.columns))


def tree_changes(stored: DataFrame, incoming: DataFrame, arrival: str = "seq") -> DataFrame:
    """The rows to write: the last tree of each incoming post, under the community the post was first
    stored under. Of ``stored`` only the two names are read, and only of these posts."""
    batch = incoming.where(F.col("link_id").isNotNull())
    known = stored.select("link_id", F.col("subreddit").alias("_stored"), F.lit(True).alias("_known"))
    known = known.join(batch.select("link_id").distinct(), "link_id", "left_semi")
    first = first_wins(batch, ["link_id"], [arrival]).select("link_id", F.col("subreddit").alias("_first"))
    named = first.join(known, "link_id", "left").select(
        "link_id", F.when(F.col("_known"), F.col("_stored")).otherwise(F.col("_first")).alias("subreddit")
    )
    last = last_wins(batch, ["link_id"], [arrival]).drop("subreddit")
    return last.join(named, "link_id").select(*stored.columns)


def merge_trees(stored: DataFrame, incoming: DataFrame, arrival: str = "seq") -> DataFrame:
    """Last tree wins, but a post keeps the community it was first stored under. The stored trees are
    neither sorted nor aggregated."""
    changes = tree_changes(stored, incoming, arrival)
    untouched = stored.where(F.col("link_id").isNotNull()).join(
        incoming.select("link_id").distinct(), "link_id", "left_anti"
    )
    return untouched.select(*stored.columns).unionByName(changes)


def merge_meta(responses: DataFrame, response: str = "response", place: str = "place") -> DataFrame:
    """First row of each response, then the last response of each community."""
    heads = first_wins(responses, ["subreddit", response], [place])
    return last_wins(heads, ["subreddit"], [response]).drop(response, place)
