"""The registered queries: name -> (spark, folder of the supplied tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import (
    epoch_date,
    json_default,
    parent_kind,
    parse_count,
    parse_timespec,
    strip_fullname,
    with_attributes,
)
from threadlake.operators import coverage, live, membership, shards, slices, stats, threads, upsert
from threadlake.operators.dedup import first_wins
from threadlake.operators.normalize import normalize_comments, normalize_meta, normalize_posts
from threadlake.scratch import write_table
from threadlake.schemas import COMMENT_CSV, POST_CSV
from threadlake.sources.archive import placed_lines
from threadlake.sources import rows_by_subreddit, scan_page, scan_window, thread_scan

from . import fixtures as fx
from .backfill import planned_load
from .requests import expand_requests as expand
from .requests import request_windows as windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

COMMUNITY = "1-urgent"
SINCE, BEFORE = fx.FIRST + fx.HALF_YEAR, fx.LAST - fx.HALF_YEAR
REFRESH_DAYS = 365
BASE_URL = "https://forum.example"


def query_as(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def query(function: Query) -> Query:
    return query_as(function.__name__)(function)


# Scans


@query
def scan_posts_page(spark, d):
    page = scan_page(fx.posts(spark, d), COMMUNITY, SINCE, BEFORE)
    return page.select("id", "subreddit", "created_utc", "title")


@query
def scan_comments_page(spark, d):
    page = scan_page(fx.comments(spark, d), COMMUNITY, SINCE, BEFORE, limit=50, sort="desc")
    return page.select("id", "link_id", "subreddit", "created_utc", "body")


@query_as("scan_window")
def scan_window_posts(spark, d):
    rows = scan_window(fx.posts(spark, d), [COMMUNITY, "5-low"], SINCE, BEFORE)
    return rows.select("id", "subreddit", "created_utc", "archive_json")



@query_as("rows_by_subreddit")
def rows_by_subreddit_posts(spark, d):
    return rows_by_subreddit(fx.posts(spark, d), "2-high").select("id", "created_utc", "author", "score")



@query
def comments_grouped(spark, d):
    return thread_scan(fx.comments(spark, d), "2-high")


@query
def page_attr_extract(spark, d):
    pages = fx.table(spark, d, "pages")
    wanted = {"lang": ("html", "lang"), "charset": ("meta", "charset")}
    return with_attributes(pages, "html", wanted, keep=["page_id"])


# Normalisation, dedup, merges


@query_as("normalize_posts")
def normalize_raw_posts(spark, d):
    rows = normalize_posts(fx.raw_posts(spark, d), "requested", fx.NOW, keep=("arrival",))
    return rows.drop("live_score", "live_num_comments", "live_refreshed_at")



@query_as("normalize_comments")
def normalize_raw_comments(spark, d):
    raw = fx.raw_comments(spark, d).select(F.col("archive_json").alias("value"))
    return normalize_comments(raw, F.lit("unknown"), fx.NOW)



@query
def set_aside_rows(spark, d):
    lines = placed_lines(fx.landed_lines(spark, d), "posts")
    return lines.where(F.col("problem").isNotNull()).select(F.col("line_place").alias("k"), "value", "problem")


@query
def dedup_first_wins(spark, d):
    rows = first_wins(fx.raw_comments(spark, d), ["id"], ["arrival"])
    return rows.select("id", "link_id", "subreddit", "created_utc", "author", "score")


@query
def existing_ids(spark, d):
    return membership.existing_ids(fx.raw_comments(spark, d), fx.stored_comments(spark, d))


@query
def fresh_records(spark, d):
    fresh = upsert.fresh_records(fx.raw_comments(spark, d), fx.stored_comments(spark, d), ["arrival"])
    return fresh.select("id", "link_id", "created_utc", "archive_json")


@query
def upsert_posts(spark, d):
    batch = normalize_posts(fx.raw_posts(spark, d), "requested", fx.NOW, keep=("arrival",))
    older = fx.posts(spark, d).where(F.col("created_utc") < fx.SPLIT)
    stored = older.select(*batch.drop("arrival").columns)
    merged = upsert.upsert(stored, batch, ["arrival"])
    return merged.select("id", "subreddit", "created_utc", "title", "is_self", "fetched_at")


@query
def upsert_comments(spark, d):
    stored = fx.stored_comments(spark, d).withColumn("author", F.lit("stored"))
    merged = upsert.upsert(stored, fx.raw_comments(spark, d), ["arrival"])
    return merged.select("id", "link_id", "parent_id", "subreddit", "created_utc", "author", "body")


@query
def merge_trees(spark, d):
    return upsert.merge_trees(fx.trees(spark, d), fx.landed_trees(spark, d))


@query
def subreddit_meta(spark, d):
    rows = normalize_meta(fx.meta_responses(spark, d), "subreddit", fx.NOW, keep=("response", "place"))
    return upsert.merge_meta(rows)


@query
def missing_trees(spark, d):
    return membership.missing_trees(fx.posts(spark, d), fx.trees(spark, d))


@query
def has_tree_flag(spark, d):
    return membership.tree_flags(fx.posts(spark, d).select("id"), fx.trees(spark, d))


@query
def csv_posts(spark, d):
    return fx.posts(spark, d).select(*POST_CSV)


@query
def csv_comments(spark, d):
    return fx.comments(spark, d).select(*COMMENT_CSV)


@query
def csv_counts(spark, d):
    return stats.csv_counts(fx.posts(spark, d), fx.comments(spark, d))


# Coverage and slices


@query
def coverage_plan(spark, d):
    return coverage.coverage_plan(fx.requests(spark, d), fx.covered(spark, d))


@query
def coverage_commit(spark, d):
    return coverage.coverage_commit(
        fx.requests(spark, d), fx.covered(spark, d), fx.outcomes(spark, d), fx.NOW
    )


@query
def incremental_load(spark, d):
    return planned_load(fx.archive(spark, d), fx.requests(spark, d), fx.covered(spark, d))


@query
def shard_bounds(spark, d):
    c = F.substring("subreddit", 2, 20).cast("bigint")
    rows = fx.requests(spark, d).select(
        "subreddit",
        "since",
        F.when(c % 13 == 0, F.col("since") - c % 2).otherwise(F.col("before")).alias("before"),
        (c % 9).alias("n"),
    )
    return shards.shard_bounds(rows)


@query
def slice_plan(spark, d):
    return slices.slice_plan(fx.posts(spark, d), SINCE, BEFORE, 8)


@query
def shard_assign(spark, d):
    slot = shards.shard_of("created_utc", SINCE, BEFORE, 8)
    return fx.posts(spark, d).select("id", "created_utc", slot.alias("shard"))


@query
def keyset_pages(spark, d):
    return shards.keyset_pages(fx.posts(spark, d), limit=100)


@query
def timespec_parse(spark, d):
    since = parse_timespec("since_spec", fx.NOW, True)
    until = parse_timespec("until_spec", fx.NOW, False)
    return fx.jobs(spark, d).select(
        "k",
        since.alias("since"),
        until.alias("until"),
        since.isNotNull().alias("since_valid"),
    )


@query
def request_windows(spark, d):
    return windows(fx.jobs(spark, d), fx.NOW).select(
        "k", "since", "before", "is_valid", "days", "since_date", "before_date"
    )


@query
def expand_requests(spark, d):
    return expand(fx.jobs(spark, d), fx.NOW)


# Threads


def _thread_store(spark, d, *columns: str) -> DataFrame:
    """The comment store as the written table it is in a run."""
    keys = ("subreddit", "link_id", "id", "parent_id", "created_utc")
    return write_table(fx.comments(spark, d).select(*keys, *columns), "comments")


@query
def thread_parents(spark, d):
    return threads.link_parents(_thread_store(spark, d)).drop("is_orphan")


@query
def thread_orphans(spark, d):
    linked = threads.link_parents(_thread_store(spark, d))
    return linked.where("is_orphan").select("subreddit", "link_id", "id", "created_utc")


@query
def thread_nodes(spark, d):
    return threads.build_forest(_thread_store(spark, d)).placed


@query
def sibling_rank(spark, d):
    return threads.sibling_rank(threads.link_parents(_thread_store(spark, d)).drop("is_orphan"))


@query
def thread_unplaced(spark, d):
    comments = _thread_store(spark, d)
    return threads.unplaced_comments(comments, threads.resolve(comments))


@query
def thread_json(spark, d):
    comments = _thread_store(spark, d, "archive_json")
    return threads.thread_json(comments, threads.build_forest(comments))


@query
def thread_totals(spark, d):
    return threads.thread_totals(threads.resolve(_thread_store(spark, d)))


# Conversations are long chains, the other shape of thread


@query
def thread_chains(spark, d):
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    before = (F.col("turn") - 1).cast("string")
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("t1_"), c, F.lit("-"), before))
    turns = fx.table(spark, d, "conversations").select(
        F.lit("talk").alias("subreddit"),
        F.concat(F.lit("t3_"), c).alias("link_id"),
        F.concat(c, F.lit("-"), t).alias("id"),
        F.coalesce(parent, F.concat(F.lit("t3_"), c)).alias("parent_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("created_utc"),
    )
    turns = write_table(first_wins(turns, ["id"], ["created_utc"]), "turns")
    return threads.build_forest(turns).placed


# Live counts


@query
def parse_counts(spark, d):
    score, comments = parse_count("score_text", signed=True), parse_count("comments_text")
    return fx.live_counts(spark, d).select(
        "id",
        "refreshed_at",
        score.value.alias("score"),
        score.broken.alias("score_broken"),
        comments.value.alias("comments"),
    )


@query
def refresh_worklist(spark, d):
    return live.refresh_worklist(
        fx.posts(spark, d), fx.NOW, REFRESH_DAYS, BASE_URL, ["1-urgent", "3-MEDIUM"]
    )


@query
def refresh_topk(spark, d):
    return live.refresh_worklist(fx.posts(spark, d), fx.NOW, REFRESH_DAYS, BASE_URL, [], limit=100)


def _outcome(spark, d) -> DataFrame:
    work = live.refresh_worklist(fx.posts(spark, d), fx.NOW, REFRESH_DAYS, BASE_URL)
    landed = fx.live_counts(spark, d).where("status <> 'P'").drop("status")  # some never landed
    return live.refresh_outcome(work, landed)


@query
def refresh_outcome(spark, d):
    return _outcome(spark, d)


@query
def refresh_totals(spark, d):
    return live.refresh_totals(_outcome(spark, d))


@query
def merge_live_counts(spark, d):
    old = F.lit(7).cast("bigint")
    posts = fx.posts(spark, d).withColumns({c: old for c in ("live_score", "live_num_comments")})
    merged = live.merge_live_counts(posts, _outcome(spark, d))
    return merged.select("id", "score", "live_score", "live_num_comments", "live_refreshed_at")


# Counts


def _stored(spark, d) -> list[DataFrame]:
    return [fx.posts(spark, d), fx.comments(spark, d), fx.trees(spark, d)]


@query
def stats_overall(spark, d):
    return stats.stats_overall(*_stored(spark, d))


@query
def stats_by_subreddit(spark, d):
    return stats.stats_by_subreddit(*_stored(spark, d))


@query
def stats_rollup(spark, d):
    return stats.stats_rollup(*_stored(spark, d))


@query
def ingest_report(spark, d):
    batch = fx.raw_comments(spark, d).withColumn("kind", F.lit("comments"))
    ident = F.when(F.col("k") % 101 != 0, F.col("id")).alias("id")  # some come without one
    batch = batch.select("kind", "subreddit", ident).unionAll(
        fx.posts(spark, d).select(F.lit("posts").alias("kind"), "subreddit", "id")
    )
    store = fx.stored_comments(spark, d).select(F.lit("comments").alias("kind"), "id")
    return stats.ingest_report(batch, store)


@query
def late_records(spark, d):
    events = fx.events(spark, d)
    # Events of small value land first, the others when the first are covered.
    small = F.col("value") < 30
    covered = events.where(small).groupBy("subreddit").agg((F.max("created_utc") - 86400).alias("until"))
    late = stats.late_records(events.where(~small), covered)
    return late.groupBy("subreddit").agg(
        F.count("*").alias("n_late"), F.min("created_utc").alias("oldest")
    )


# Scalar functions over whole tables


@query_as("strip_fullname")
def strip_fullname_all(spark, d):
    return fx.names(spark, d).select("k", strip_fullname("fullname").alias("bare"))



@query_as("parent_kind")
def parent_kind_all(spark, d):
    return fx.names(spark, d).select("k", parent_kind("fullname").alias("kind"))



@query_as("epoch_date")
def epoch_dates(spark, d):
    moved = F.col("created_utc") - F.col("k") * 400000
    return fx.posts(spark, d).select(
        "id", epoch_date("created_utc").alias("day"), epoch_date(moved).alias("moved_day")
    )



@query
def json_path_default(spark, d):
    k = F.col("k")
    doc = (
        F.when(k % 4 == 0, F.concat(F.lit('{"a": {"b": '), "archive_json", F.lit("}}")))
        .when(k % 4 == 1, F.concat(F.lit('{"a": {"b": {"c": '), "archive_json", F.lit("}}}")))
        .when(k % 4 == 2, F.concat(F.lit('{"a": 5, "d": '), "archive_json", F.lit("}")))
        .otherwise(F.col("archive_json"))
    )
    return fx.events(spark, d).select(
        "id", json_default(doc, "a.b.k", "x").alias("found"), json_default(doc, "z", None).alias("missing")
    )


@query
def json_roundtrip(spark, d):
    turns = fx.table(spark, d, "conversations")
    coded = turns.select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("coded"))
    back = coded.select("conv_id", "turn", F.from_json("coded", "role string, text string").alias("r"))
    return back.select("conv_id", "turn", "r.role", "r.text")
