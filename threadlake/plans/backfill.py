"""One run over all communities at once: plan, load, dedup, append, commit, threads, exports.

Data is written before the cover that vouches for it. A run that dies in between leaves the cover
as it was; the next run plans the same windows and the anti join drops what had landed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.coverage import (
    changed_covers,
    coverage_commit,
    coverage_plan,
    incremental_load,
    merge_requests,
)
from threadlake.operators.dedup import first_wins
from threadlake.operators.live import PAGE_TAG, page_counts, refresh_outcome, refresh_worklist
from threadlake.operators.membership import absent_from, missing_trees
from threadlake.operators.normalize import normalize_comments, normalize_meta, normalize_posts
from threadlake.operators.stats import csv_counts, ingest_report
from threadlake.operators.threads import build_forest, post_counts, rolled_up, thread_json
from threadlake.operators.upsert import merge_meta, tree_changes
from threadlake.scratch import Scratch, write_table
from threadlake.sinks import append_jsonl, append_trees, write_csv, write_threads
from threadlake.sources.store import Store

NORMALIZE = {"posts": normalize_posts, "comments": normalize_comments}


@dataclass(frozen=True)
class Exports:
    path: str | None = None
    jsonl: bool = True
    csv: bool = False


def planned_load(archive: DataFrame, requests: DataFrame, covered: DataFrame) -> DataFrame:
    """Archive records in the missing windows of the requests."""
    return incremental_load(archive, coverage_plan(requests, covered))


def run_backfill(
    store: Store,
    archive: DataFrame,
    requests: DataFrame,
    now: int,
    arrival: list[str],
    exports: Exports = Exports(),
) -> DataFrame:
    """Bring the store up to ``requests``; returns the report of fetched and new rows.

    ``archive``: kind, subreddit, created_utc, id, value (raw JSON) and the arrival columns. Lines
    with a ``problem`` are set aside with it before anything is loaded. Each loaded record is parsed
    once.
    """
    scratch = Scratch(store.spark, "backfill")
    if "problem" in archive.columns:
        odd = scratch.write(archive.where(F.col("problem").isNotNull()), "odd")
        for kind in NORMALIZE:
            store.set_aside_landed(kind, odd.where(F.col("kind") == kind), now, arrival)
        archive = archive.where(F.col("problem").isNull()).drop("problem")
    wanted = requests.where(F.col("kind").isin(*NORMALIZE))
    requests = scratch.write(merge_requests(wanted), "requests")
    covered = scratch.write(store.read("covered_range"), "covered")
    plan = scratch.write(coverage_plan(requests, covered), "plan")
    loaded = scratch.write(incremental_load(archive, plan), "loaded")
    reports = []
    for kind, normalize in NORMALIZE.items():
        raw = loaded.where(F.col("kind") == kind)
        rows = scratch.write(normalize(raw, F.col("subreddit"), now, keep=tuple(arrival)), "rows")
        known = scratch.write(store.known_ids(kind, rows), "known")
        tagged = rows.withColumn("kind", F.lit(kind))
        report = ingest_report(tagged, known.withColumn("kind", F.lit(kind)))
        reports.append(write_table(report, "report"))
        fresh = scratch.write(absent_from(first_wins(rows, ["id"], arrival), known), "fresh")
        store.append(kind, fresh)
        store.set_aside(kind, rows, arrival)
        if exports.path:
            append_jsonl(fresh, exports.path, kind, exports.jsonl)
    outcomes = plan.select("subreddit", "kind", "window_type", F.lit(True).alias("ok"))
    grown = changed_covers(coverage_commit(requests, covered, outcomes, now), covered)
    store.change("covered_range", grown)
    scratch.drop_all()
    return reports[0].unionByName(reports[1])


def _of_communities(rows: DataFrame, subreddits: DataFrame | None, column: str) -> DataFrame:
    if subreddits is None:
        return rows
    wanted = subreddits.select(F.lower("subreddit").alias(column)).distinct()
    return rows.join(wanted, column, "left_semi")


def run_threads(
    store: Store, subreddits: DataFrame | None, exports: Exports, rebuild: bool = False
) -> DataFrame:
    """Bring the threads of the named communities (all when None) up to date; returns their totals.

    Only posts that got comments since the last time are resolved, ordered and written, each with
    all its comments; ``rebuild`` takes all posts. The lines of all posts lie in ``thread_lines``.
    """
    keys = ["community", "link_id"]
    scratch = Scratch(store.spark, "thread-run")
    comments = _of_communities(store.read("comments"), subreddits, "community")
    marks, touched = store.touched_posts()
    touched = scratch.write(touched, "touched")
    mine = scratch.write(_of_communities(touched, subreddits, "community"), "mine")
    if rebuild or not mine.isEmpty():
        if not rebuild:
            columns = ["subreddit", "community", "link_id", "id", "parent_id", "created_utc", "archive_json"]
            comments = scratch.write(comments.select(*columns).join(mine, keys, "left_semi"), "comments")
        forest = build_forest(comments).written()
        named = F.col("subreddit").alias("community")  # threads name a community in lower case
        store.change("thread_lines", thread_json(comments, forest).select(named, "*"))
        store.change("thread_posts", post_counts(forest).select(named, "*"))
        forest.scratch.drop_all()
    # The marks go when what they ask for is written; other communities' posts are marked anew.
    store.untouch(marks, touched.join(mine, keys, "left_anti"))
    if exports.path:
        lines = _of_communities(store.read("thread_lines"), subreddits, "community")
        write_threads(lines.select("subreddit", "link_id", "pos", "text"), exports.path)
    scratch.drop_all()
    return rolled_up(_of_communities(store.read("thread_posts"), subreddits, "community"))


def run_trees(store: Store, landed: DataFrame, now: int, exports: Exports = Exports()) -> None:
    """Take landed trees (link_id, subreddit, tree_json, seq) of posts that have none yet; as many
    trees are written as have landed."""
    stored = store.read("comment_trees")
    lacking = missing_trees(store.read("posts"), stored).select(F.col("id").alias("link_id"))
    taken = landed.join(lacking, "link_id", "left_semi").withColumn(
        "fetched_at", F.lit(now).cast("bigint")
    )
    taken = write_table(taken, "trees")
    store.change("comment_trees", tree_changes(stored, taken))
    if exports.path:
        append_trees(taken, exports.path, exports.jsonl)


def run_meta(store: Store, responses: DataFrame, now: int) -> None:
    """Community facts from landed responses (subreddit, value, response, place): the last one of
    each community replaces what is stored."""
    rows = normalize_meta(responses, "subreddit", now, keep=("response", "place"))
    store.change("subreddit_meta", merge_meta(rows))


def run_refresh(
    store: Store,
    pages: DataFrame,
    now: int,
    window_days: int = 30,
    tag: str = PAGE_TAG,
    base_url: str = "",
    **worklist,
) -> DataFrame:
    """Refresh recent posts from landed pages (id, html, refreshed_at); returns the outcome."""
    work = refresh_worklist(store.read("posts"), now, window_days, base_url, **worklist)
    outcome = write_table(refresh_outcome(work, page_counts(pages, tag)), "outcome")
    fresh = outcome.where(F.col("outcome") == "refreshed")
    store.change("live_counts", fresh)
    return outcome


def run_export(store: Store, path: str, subreddits: DataFrame | None = None) -> DataFrame:
    """Flat exports of the named communities (all when None); returns the row counts."""
    posts, comments = store.posts_with_live_counts(), store.read("comments")
    if subreddits is not None:
        wanted = subreddits.select(F.lower("subreddit").alias("_asked")).distinct()
        posts, comments = (
            t.join(wanted, F.lower(t["subreddit"]) == wanted["_asked"], "left_semi")
            for t in (posts, comments)
        )
    write_csv(posts, path, "posts")
    write_csv(comments, path, "comments")
    return csv_counts(posts, comments)
