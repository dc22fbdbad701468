"""Tail ingest: records landed after the covered end, each exactly once, and the cover that follows.

The stream checkpoint remembers which files were read, the store's ledger which batches are done. A
batch that is replayed although it is done is skipped. One that died half-way is done again: the
store drops the ids it had appended, and lines set aside are kept once. The store is the unbounded
dedup memory; no streaming state grows with the archive.

Covers advance when a run has loaded all that had landed (``run_tail``), not batch by batch: batches
of one run come in any order of time, and an early one must not make a later one's records late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.operators.coverage import tail_commit
from threadlake.operators.dedup import first_wins
from threadlake.operators.membership import absent_from
from threadlake.operators.normalize import normalize_comments, normalize_posts, with_problem
from threadlake.operators.skew import HOT_ROWS, lookup
from threadlake.scratch import Scratch
from threadlake.sources.archive import ARRIVAL, landed_records, with_line_place
from threadlake.sources.store import Store

NORMALIZE = {"posts": normalize_posts, "comments": normalize_comments}


def tail_rows(
    rows: DataFrame, covered: DataFrame, lateness: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows at or after the covered end of their community (all rows where nothing is covered).

    ``covered`` is the cover of one kind. ``lateness`` seconds before the end are read again, for
    records that land late; dedup drops those already stored.
    """
    ends = covered.groupBy(F.lower("subreddit").alias("_community")).agg(F.max("until").alias("_end"))
    keyed = rows.withColumn("_community", F.lower("subreddit"))
    joined = lookup(keyed, ends, ["_community"], "left", hot_rows)
    wanted = F.col("_end").isNull() | (F.col("created_utc") >= F.col("_end") - lateness)
    return joined.where(wanted).select(*rows.columns)


def follow_tail(
    store: Store,
    landed: str,
    kind: str,
    checkpoint: str,
    fetched_at: int,
    covered: DataFrame | None = None,
    lateness: int = 0,
    **source_options,
) -> StreamingQuery:
    """Load everything that has landed since the last run, then stop.

    ``landed`` may have one folder per community: ``subreddit=<name>/``. Lines that no window can
    hold, and records without an id, are set aside with a reason.
    """
    stream = landed_records(store.spark, landed, stream=True, **source_options)
    commits = store.commits

    def load(batch: DataFrame, number: int) -> None:
        name = commits.stream_of(checkpoint)
        if commits.is_done(name, number):
            return
        scratch = Scratch(store.spark, "tail")
        folder = F.col("subreddit") if "subreddit" in batch.columns else F.lit(None).cast("string")
        rows = NORMALIZE[kind](with_line_place(batch), folder, fetched_at, keep=("_time", *ARRIVAL))
        rows = scratch.write(with_problem(rows), "rows")
        odd = rows.where(F.col("problem").isNotNull())
        store.set_aside_landed(kind, odd.withColumn("value", F.col("archive_json")), fetched_at, ARRIVAL)
        good = rows.where(F.col("problem").isNull()).drop("problem")
        if covered is not None:
            good = tail_rows(good, covered, lateness)
        first = first_wins(good, ["id"], ARRIVAL)
        fresh = scratch.write(absent_from(first, store.known_ids(kind, good)), "fresh")
        store.append(kind, fresh)
        store.set_aside(kind, good, ARRIVAL)
        counts = {"lines": rows.count(), "fresh": fresh.count(), "problems": odd.count()}
        commits.finish(name, number, counts, rows.select(F.lower("subreddit").alias("subreddit")).distinct())
        scratch.drop_all()

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_tail(
    store: Store,
    landed: str,
    kind: str,
    checkpoint: str,
    now: int,
    before: int | None = None,
    lateness: int = 0,
    **source_options,
) -> dict[str, int]:
    """Follow a landed folder to its end and advance the covers of its communities to ``before`` (by
    default ``now``); returns what the batches of this run counted.

    Only records from the covered end on are loaded, and a community without a cover is loaded
    whole. What has landed with a time of ``before`` or later is stored as well, and found again by
    the next backfill.
    """
    covered = Scratch(store.spark, "covers").write(store.read("covered_range").where(F.col("kind") == kind), "covers")
    known = _done(store, checkpoint)
    query = follow_tail(store, landed, kind, checkpoint, now, covered, lateness, **source_options)
    query.awaitTermination()
    stream = store.commits.stream_of(checkpoint)
    grown = tail_commit(
        store.commits.followed(stream), store.read("covered_range"), kind, now if before is None else before, now
    )
    if not grown.isEmpty():
        store.change("covered_range", grown)
    counts: dict[str, int] = {"lines": 0, "fresh": 0, "problems": 0}
    for batch, made in store.commits.counts(stream).items():
        if batch not in known:
            counts = {name: n + made[name] for name, n in counts.items()}
    return counts


def _done(store: Store, checkpoint: str) -> set[int]:
    if not store._exists(f"{checkpoint.rstrip('/')}/metadata"):
        return set()
    return set(store.commits.batches(store.commits.stream_of(checkpoint)))


def dedup_within_watermark(records: DataFrame, delay: str) -> DataFrame:
    """First copy of each id among records within ``delay`` of each other.

    Keeps bounded state, for streams that need no store: a copy that comes later than the delay is
    let through again.
    """
    timed = records.withColumn("_time", F.timestamp_seconds("created_utc"))
    return timed.withWatermark("_time", delay).dropDuplicatesWithinWatermark(["id"]).drop("_time")
