"""Stages of a job over landed data, for all its communities at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.stats import stats_rollup
from threadlake.scratch import write_table
from threadlake.sources.store import Store

from .backfill import (
    Exports,
    run_backfill,
    run_export,
    run_meta,
    run_refresh,
    run_threads,
    run_trees,
)
from .requests import expand_requests

# The names a job may ask for.
STAGES = ("all", "backfill", "threads", "refresh", "stats", "export")


@dataclass(frozen=True)
class Landed:
    """Landed inputs. ``archive`` as for ``run_backfill``, with its arrival columns; ``meta`` as
    for ``run_meta``; ``trees`` as for ``run_trees``; ``pages`` as for ``run_refresh``."""

    archive: DataFrame | None = None
    arrival: tuple[str, ...] = ()
    meta: DataFrame | None = None
    trees: DataFrame | None = None
    pages: DataFrame | None = None


def _asked(rows: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    names = requests.where(F.col("kind") == kind).select(F.lower("subreddit").alias("_asked"))
    keyed = rows.withColumn("_asked", F.lower("subreddit"))
    return keyed.join(names.distinct(), "_asked", "left_semi").drop("_asked")


def run_stage(
    store: Store,
    jobs: DataFrame,
    landed: Landed,
    now: int,
    stage: str = "all",
    exports: Exports = Exports(),
    threads: bool = True,
    refresh: bool = False,
    window_days: int = 30,
    limit: int = 0,
    base_url: str = "",
) -> dict[str, DataFrame]:
    """Run a stage; returns its reports by name. ``jobs`` as for ``expand_requests``.

    ``all`` is backfill and threads, and with ``refresh`` also the refresh of recent posts, at most
    ``limit`` of them (0: all). Exports replace the files of the asked communities only.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}: one of {', '.join(STAGES)}")
    reports: dict[str, DataFrame] = {}
    requests = write_table(expand_requests(jobs, now), "requests")
    names = requests.select("subreddit").distinct()
    if stage == "export":
        return {"export": run_export(store, exports.path, names)}
    if stage in ("all", "backfill"):
        if landed.meta is not None:
            run_meta(store, _asked(landed.meta, requests, "meta"), now)
        reports["backfill"] = run_backfill(
            store, landed.archive, requests, now, list(landed.arrival), exports
        )
        if landed.trees is not None:
            run_trees(store, _asked(landed.trees, requests, "trees"), now, exports)
    if threads and stage in ("all", "backfill", "threads"):
        commented = requests.where(F.col("kind") == "comments").select("subreddit")
        reports["threads"] = run_threads(store, commented, exports)
    if stage == "refresh" or (stage == "all" and refresh):
        reports["refresh"] = run_refresh(
            store, landed.pages, now, window_days, base_url=base_url, subreddits=names, limit=limit
        )
    if exports.csv and stage in ("all", "backfill"):
        reports["export"] = run_export(store, exports.path, names)
    reports["stats"] = stats_rollup(
        store.read("posts"), store.read("comments"), store.read("comment_trees")
    )
    return reports
