import pytest

from threadlake.operators.live import (
    merge_live_counts,
    page_counts,
    refresh_outcome,
    refresh_totals,
    refresh_worklist,
)

POSTS = (
    "id string, subreddit string, permalink string, created_utc bigint, "
    "live_score bigint, live_num_comments bigint, live_refreshed_at bigint"
)
DAY = 86400


def posts(spark):
    rows = [
        ("new", "A", "/new", 100 * DAY, 7, 7, 1),
        ("edge", "a", "/edge", 70 * DAY, 7, 7, 1),
        ("old", "A", "/old", 70 * DAY - 1, 7, 7, 1),
        ("other", "B", "/other", 90 * DAY, 7, 7, 1),
        ("nolink", "B", None, 91 * DAY, 7, 7, 1),
        ("empty", "B", "", 92 * DAY, 7, 7, 1),
    ]
    return spark.createDataFrame(rows, POSTS)


def work(spark, **how):
    return [r.id for r in refresh_worklist(posts(spark), 100 * DAY, 30, "https://f", **how).collect()]


def test_worklist(spark):
    assert work(spark) == ["new", "empty", "nolink", "other", "edge"]
    assert work(spark, subreddits=[]) == work(spark)
    assert work(spark, subreddits=["A"]) == ["new", "edge"]
    assert work(spark, subreddits=spark.createDataFrame([("b",)], "subreddit string")) == ["empty", "nolink", "other"]
    assert work(spark, limit=2) == ["new", "empty"]
    assert work(spark, limit=0) == work(spark)
    urls = {r.id: r.url for r in refresh_worklist(posts(spark), 100 * DAY, 30, "https://f").collect()}
    assert (urls["new"], urls["nolink"], urls["empty"]) == ("https://f/new", None, None)


@pytest.mark.parametrize(
    "score, comments, expected",
    [
        ("12", "3", ("refreshed", 12, 3)),
        ("-3", "-3", ("refreshed", -3, None)),
        ("1.2k", "4", ("refreshed", None, 4)),
        ("", "4", ("refreshed", None, 4)),
        ("5", None, ("refreshed", 5, None)),
        (None, "4", ("failed", 7, 7)),
        ("--5", "4", ("failed", 7, 7)),
        ("5", "99999999999999999999", ("failed", 7, 7)),
    ],
)
def test_outcome_and_merge(spark, score, comments, expected):
    attrs = "" if score is None else f' score="{score}"'
    attrs += "" if comments is None else f" comment-count='{comments}'"
    pages = spark.createDataFrame(
        [("new", "<x-post score='1' comment-count='1'>", 5), ("new", f"<b><x-post{attrs}>", 9), ("ghost", "<x-post score=1>", 9)],
        "id string, html string, refreshed_at bigint",
    )
    todo = refresh_worklist(posts(spark), 100 * DAY, 30, "", ["a"], limit=1)
    outcome = refresh_outcome(todo, page_counts(pages, "x-post"))
    assert [r.outcome for r in outcome.collect()] == [expected[0]]
    merged = {r.id: r for r in merge_live_counts(posts(spark), outcome).collect()}
    assert (merged["new"].live_score, merged["new"].live_num_comments) == expected[1:]
    assert merged["new"].live_refreshed_at == (9 if expected[0] == "refreshed" else 1)
    assert merged["old"].live_score == 7 and len(merged) == 6


def test_totals(spark):
    pages = spark.createDataFrame(
        [(i, "<x-post score=1>", 5) for i in ("new", "nolink", "empty")],
        "id string, html string, refreshed_at bigint",
    )
    todo = refresh_worklist(posts(spark), 100 * DAY, 30, "")
    totals = refresh_totals(refresh_outcome(todo, page_counts(pages, "x-post"))).collect()
    assert {r.subreddit: tuple(r)[1:] for r in totals} == {
        None: (1, 4, 5), "A": (1, 0, 1), "a": (0, 1, 1), "B": (0, 3, 3),
    }
