"""Which part of a requested window is still missing, and what a run has covered.

A cover is one interval per (community, kind). A request beyond it needs an ``older`` window
before the cover, a ``tail`` window after it, or both; without a cover, one ``full`` window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import month_of_epoch
from threadlake.functions.times import MAX_EPOCH

KEYS = ["subreddit", "kind"]


def merge_requests(requests: DataFrame) -> DataFrame:
    """One request per (lower-case community, kind): from the earliest start to the latest end.

    A cover is a single interval, so loading requests one after the other fills what lies between
    them as well.
    """
    return requests.groupBy(F.lower("subreddit").alias("subreddit"), "kind").agg(
        F.min("since").alias("since"), F.max("before").alias("before")
    )


def _window(name: str, since: Column, before: Column, wanted: Column) -> Column:
    return F.when(
        wanted,
        F.struct(F.lit(name).alias("window_type"), since.alias("since"), before.alias("before")),
    )


def coverage_plan(requests: DataFrame, covered: DataFrame) -> DataFrame:
    """Windows to load: (subreddit, kind, window_type, since, before); none if all is covered."""
    cover = covered.select(*KEYS, F.col("since").alias("_cs"), F.col("until").alias("_cu"))
    r = requests.select(*KEYS, "since", "before").join(cover, KEYS, "left")
    s, b, cs, cu = (F.col(c) for c in ("since", "before", "_cs", "_cu"))
    windows = F.array_compact(
        F.array(
            _window("full", s, b, cs.isNull()),
            _window("older", s, cs, s < cs),
            _window("tail", cu, b, b > cu),
        )
    )
    return r.select(*KEYS, F.explode(windows).alias("w")).select(*KEYS, "w.*")


def coverage_commit(
    requests: DataFrame, covered: DataFrame, outcomes: DataFrame, now: int
) -> DataFrame:
    """Cover after a run; ``outcomes`` holds ``ok`` per (subreddit, kind, window_type).

    A window that failed or has no outcome leaves its side of the cover as it was.
    """
    done = outcomes.groupBy(*KEYS).agg(
        *[
            F.coalesce(
                F.bool_or(F.when(F.col("window_type") == name, F.col("ok"))), F.lit(False)
            ).alias(f"_{name}")
            for name in ("full", "older", "tail")
        ]
    )
    cover = covered.select(
        *KEYS,
        F.col("since").alias("_cs"),
        F.col("until").alias("_cu"),
        F.col("updated_at").alias("_at"),
    )
    rows = (
        requests.select(*KEYS, "since", "before").join(cover, KEYS, "full").join(done, KEYS, "left")
    )
    s, b, cs, cu = (F.col(c) for c in ("since", "before", "_cs", "_cu"))

    def ok(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(False))

    first = cs.isNull() & ok("full")
    older = ok("older") & (s < cs)
    tail = ok("tail") & (b > cu)
    return rows.select(
        *KEYS,
        F.when(first, s).when(older, F.least(cs, s)).otherwise(cs).alias("since"),
        F.when(first, b).when(tail, b).otherwise(cu).alias("until"),
        F.when(first | older | tail, F.lit(now).cast("bigint"))
        .otherwise(F.col("_at"))
        .alias("updated_at"),
    ).where(F.col("since").isNotNull())


def widest_covers(covers: DataFrame) -> DataFrame:
    """One cover per (community, kind) of several that were each grown from an earlier one."""
    return covers.groupBy(*KEYS).agg(
        F.min("since").alias("since"), F.max("until").alias("until"), F.max("updated_at").alias("updated_at")
    )


def changed_covers(after: DataFrame, before: DataFrame) -> DataFrame:
    """Covers of ``after`` that are new or wider: the rows to write."""
    return after.join(before.select(*KEYS, "since", "until"), [*KEYS, "since", "until"], "left_anti").select(*after.columns)


def tail_commit(followed: DataFrame, covered: DataFrame, kind: str, before: int, now: int) -> DataFrame:
    """Covers of the followed communities, ``before`` which all their records have been loaded.

    A tail starts where a cover ends; a community without a cover has no start to vouch for.
    """
    names = followed.select(F.lower("subreddit").alias("subreddit")).distinct()
    grown = covered.where((F.col("kind") == kind) & (F.col("until") < before))
    return grown.join(names, "subreddit", "left_semi").select(
        "subreddit",
        "kind",
        "since",
        F.lit(before).cast("bigint").alias("until"),
        F.lit(now).cast("bigint").alias("updated_at"),
    )


def windows_by_month(plan: DataFrame) -> DataFrame:
    """One row per planned window and calendar month it touches.

    The month is an equality key beside the community: it prunes the archive's month folders
    and splits the records of one huge community over as many join keys as it has months.
    """
    first = F.greatest("since", F.lit(-MAX_EPOCH))
    last = F.least(F.col("before"), F.lit(MAX_EPOCH)) - 1
    months = F.sequence(month_of_epoch(first), month_of_epoch(F.greatest(first, last)))
    return plan.where(F.col("before") > F.col("since")).withColumn(
        "created_month", F.explode(months)
    )


def incremental_load(archive: DataFrame, plan: DataFrame) -> DataFrame:
    """Archive records inside a planned window, with the type of that window.

    Windows of one (community, kind) never overlap, so no record comes twice. Communities match
    whatever their case. An archive laid out by ``created_month`` is read only where needed.
    """
    columns = [c for c in archive.columns if c not in ("created_month", "community")]
    if "created_month" not in archive.columns:
        archive = archive.withColumn("created_month", month_of_epoch("created_utc"))
    if "community" not in archive.columns:
        archive = archive.withColumn("community", F.lower("subreddit"))
    windows = windows_by_month(plan).select(
        F.lower("subreddit").alias("_community"),
        F.col("kind").alias("_kind"),
        F.col("created_month").alias("_month"),
        "window_type",
        F.col("since").alias("_since"),
        F.col("before").alias("_before"),
    )
    inside = (
        (archive["community"] == windows["_community"])
        & (archive["kind"] == windows["_kind"])
        & (archive["created_month"] == windows["_month"])
        & (archive["created_utc"] >= windows["_since"])
        & (archive["created_utc"] < windows["_before"])
    )
    return archive.join(windows, inside, "inner").select(*columns, "window_type")
