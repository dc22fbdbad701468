"""Whole runs and streams: repeated, widened, interrupted."""

import json

import pytest
from pyspark.sql import functions as F

from threadlake.functions import month_of_epoch
from threadlake.operators.normalize import normalize_comments
from threadlake.operators.upsert import fresh_records
from threadlake.plans.backfill import Exports, run_backfill, run_export, run_meta, run_refresh, run_threads, run_trees
from threadlake.plans.requests import expand_requests
from threadlake.plans.stages import Landed, run_stage
from threadlake.schemas import COVERED, REQUESTS
from threadlake.sources import Store, landed_archive, landed_records, rows_by_subreddit, scan_page, scan_window, thread_scan
from threadlake.sources.archive import ARRIVAL
from threadlake.streaming import dedup_within_watermark, follow_tail, run_tail

DAY = 86400


def archive(spark, n=60):
    rows = []
    for i in range(n):
        t = i * DAY
        post = {"id": f"p{i}", "created_utc": t, "title": f"t{i}", "permalink": f"/p{i}"}
        rows.append(("posts", "Py", t, f"p{i}", json.dumps(post), i))
        for j, parent in enumerate([f"t3_p{i}", f"t1_c{i}x0"]):
            c = {"id": f"c{i}x{j}", "link_id": f"t3_p{i}", "parent_id": parent, "created_utc": t + j, "body": "b"}
            rows.append(("comments", "Py", t + j, c["id"], json.dumps(c), i))
            rows.append(("comments", "Py", t + j, c["id"], json.dumps({**c, "body": "copy"}), i + 1000))
    return spark.createDataFrame(
        rows, "kind string, subreddit string, created_utc bigint, id string, value string, arrival bigint"
    )


def ask(spark, since, before):
    return spark.createDataFrame([("py", k, since, before) for k in ("posts", "comments")], REQUESTS)


def report(df):
    return {r.kind: (r.fetched, r.distinct_ids, r.new_rows) for r in df.collect()}


def covers(store):
    return {r.kind: (r.since, r.until) for r in store.read("covered_range").collect()}


def test_backfill_runs(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "store")), archive(spark)
    out = Exports(str(tmp_path / "out"))
    first = run_backfill(store, source, ask(spark, 20 * DAY, 40 * DAY), 5, ["arrival"], out)
    assert report(first) == {"posts": (20, 20, 20), "comments": (80, 40, 40)}
    assert covers(store) == dict.fromkeys(["posts", "comments"], (20 * DAY, 40 * DAY))

    again = run_backfill(store, source, ask(spark, 20 * DAY, 40 * DAY), 6, ["arrival"], out)
    assert report(again) == {}

    wider = run_backfill(store, source, ask(spark, 0, 60 * DAY), 7, ["arrival"], out)
    assert report(wider) == {"posts": (40, 40, 40), "comments": (160, 80, 80)}
    comments = store.read("comments")
    assert comments.count() == 120 and comments.where("body = 'b'").count() == 120
    assert store.read("posts").select("id").distinct().count() == 60
    assert covers(store)["posts"] == (0, 60 * DAY)
    assert spark.read.text(str(tmp_path / "out" / "comments.jsonl")).count() == 120

    totals = run_threads(store, None, out).where("is_overall = 1").first()
    assert (totals.posts_with_threads, totals.comments_in_tree) == (60, 120)
    none = run_threads(store, spark.createDataFrame([("rust",)], "subreddit string"), Exports())
    assert none.where("is_overall = 0").count() == 0
    line = spark.read.text(str(tmp_path / "out" / "threads.jsonl")).where("value like '%\"p7\"%'").first().value
    (top,) = json.loads(line)["tree"]
    assert top["id"] == "c7x0" and [r["id"] for r in top["replies"]] == ["c7x1"]


def test_a_failed_run_is_repeated(spark, tmp_path, monkeypatch):
    store, source = Store(spark, str(tmp_path)), archive(spark, 10)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "change", dies)
        with pytest.raises(RuntimeError):
            run_backfill(store, source, ask(spark, 0, 10 * DAY), 5, ["arrival"])
    assert covers(store) == {} and store.read("posts").count() == 10
    again = run_backfill(store, source, ask(spark, 0, 10 * DAY), 6, ["arrival"])
    assert report(again) == {"posts": (10, 10, 0), "comments": (40, 20, 0)}
    assert store.read("posts").count() == 10 and covers(store)["posts"] == (0, 10 * DAY)


def test_overlapping_requests_load_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    asked = spark.createDataFrame(
        [("py", "posts", 0, 6 * DAY), ("PY", "posts", 4 * DAY, 10 * DAY), ("py", "meta", 0, 5)], REQUESTS
    )
    first = run_backfill(store, archive(spark, 10), asked, 5, ["arrival"])
    assert report(first) == {"posts": (10, 10, 10)}
    assert covers(store) == {"posts": (0, 10 * DAY)}


def test_backfill_from_landed_files(spark, tmp_path):
    land(tmp_path / "landed", "1.jsonl", ("a", 1, "first"), ("b", 2 * DAY, "b"), ("a", 3, "copy"))
    land(tmp_path / "landed", "2.jsonl", ("c", 9 * DAY, "too new"))
    with (tmp_path / "landed" / "subreddit=Py" / "1.jsonl").open("a") as f:
        f.write('not json\n{"created_utc": 5, "body": "no id"}\n')
    store, source = Store(spark, str(tmp_path / "store")), landed_archive(spark, str(tmp_path / "landed"), "comments")
    first = run_backfill(store, source, ask(spark, 0, 5 * DAY), 5, ARRIVAL)
    assert report(first) == {"comments": (4, 2, 2)}  # one of them without an id
    assert stored(store) == {"a": "first", "b": "b"}
    lost = spark.read.parquet(str(tmp_path / "store" / "no_id" / "comments"))
    assert {r.archive_json for r in lost.collect()} == {"not json", '{"created_utc": 5, "body": "no id"}'}
    assert {r.subreddit for r in store.read("comments").collect()} == {"Py"}


def test_lines_that_no_window_holds_are_kept_once(spark, tmp_path):
    start = 1119225600
    folder = tmp_path / "landed" / "subreddit=007"
    land(tmp_path / "landed", "1.jsonl", ("a", start + 5, "good"))
    folder.mkdir()
    (folder / "1.jsonl").write_text(
        '{"id": "n", "created_utc": null}\n{"id": "t", "created_utc": "soon"}\nnot json\n'
        f'{{"id": "us", "created_utc": {start}000000}}\n{{"created_utc": {start + 7}}}\n'
        f'{{"id": "d", "created_utc": {start + 9}, "body": "digits"}}\n'
    )
    store, source = Store(spark, str(tmp_path / "store")), landed_archive(spark, str(tmp_path / "landed"), "comments")
    asked = spark.createDataFrame(
        [("py", "comments", start, 10**15), ("007", "comments", start, 10**15)], REQUESTS
    )
    for now in (5, 6):
        run_backfill(store, source, asked, now, ARRIVAL)
        kept = spark.read.parquet(str(tmp_path / "store" / "no_id" / "comments")).collect()
        assert sorted(r.reason for r in kept) == ["no id", "no json", "no time", "no time", "time out of range"]
        assert {r.subreddit for r in kept} == {"007"}
    assert stored(store) == {"a": "good", "d": "digits"}


def test_scans_of_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    run_backfill(store, archive(spark), ask(spark, 0, 60 * DAY), 5, ["arrival"])
    posts = store.read("posts")
    assert scan_window(posts, ["PY"], 10 * DAY, 50 * DAY).count() == 40
    assert [r.id for r in scan_page(posts, "py", 10 * DAY, 50 * DAY, limit=2).collect()] == ["p10", "p11"]
    assert [r.id for r in scan_page(posts, "py", 0, 50 * DAY, 2, "desc").collect()] == ["p49", "p48"]
    assert [r.id for r in rows_by_subreddit(posts, "Py").limit(2).collect()] == ["p0", "p1"]
    links = [r.link_id for r in thread_scan(store.read("comments"), "py").collect()]
    assert len(links) == 120 and links == sorted(links)


def test_trees_meta_refresh_and_export(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    out = Exports(str(tmp_path / "out"))
    run_backfill(store, archive(spark, 5), ask(spark, 0, 5 * DAY), 5, ["arrival"])
    landed = spark.createDataFrame(
        [("p1", "Py", "[1]", 1), ("p1", "Py", "[2]", 2), ("zz", "Py", "[3]", 1)],
        "link_id string, subreddit string, tree_json string, seq bigint",
    )
    run_trees(store, landed, 9, out)
    run_trees(store, landed.withColumn("tree_json", F.lit("[9]")), 10, out)
    assert [tuple(r) for r in store.read("comment_trees").collect()] == [("p1", "Py", "[2]", 9)]

    responses = spark.createDataFrame([("Py", '{"subscribers": 5}', 1, 0)], "subreddit string, value string, response bigint, place bigint")
    run_meta(store, responses, 3)
    run_meta(store, responses.withColumn("value", F.lit('{"subscribers": 6}')), 4)
    assert [(r.subscribers, r.fetched_at) for r in store.read("subreddit_meta").collect()] == [(6, 4)]

    pages = spark.createDataFrame([("p4", "<x-post score=3>", 7)], "id string, html string, refreshed_at bigint")
    outcome = run_refresh(store, pages, 5 * DAY, 2, "x-post")
    assert {r.id: r.outcome for r in outcome.collect()} == {"p3": "failed", "p4": "refreshed"}
    newer = pages.withColumn("html", F.lit("<x-post score=x>")).withColumn("refreshed_at", F.lit(8))
    run_refresh(store, newer, 5 * DAY, 2, "x-post")
    live = {r.id: (r.live_score, r.live_refreshed_at) for r in store.posts_with_live_counts().collect()}
    assert live["p4"] == (None, 8) and live["p3"] == (None, None) and len(live) == 5
    counts = {r.export: r.n_rows for r in run_export(store, str(tmp_path / "out")).collect()}
    assert counts == {"posts": 5, "comments": 10}


def test_stages(spark, tmp_path):
    store, out = Store(spark, str(tmp_path / "store")), Exports(str(tmp_path / "out"), csv=True)
    jobs = spark.createDataFrame(
        [("py, rust", "0", str(20 * DAY), True, True, True, True)],
        "subreddits string, since_spec string, until_spec string, fetch_posts boolean, "
        "fetch_comments boolean, fetch_trees boolean, fetch_meta boolean",
    )
    layout = "subreddit string, value string, response bigint, place bigint"
    landed = Landed(
        archive(spark),
        ("arrival",),
        spark.createDataFrame([("PY", "{}", 1, 0), ("elsewhere", "{}", 1, 0)], layout),
        spark.createDataFrame([("p1", "Py", "[]", 1)], "link_id string, subreddit string, tree_json string, seq bigint"),
        spark.createDataFrame([("p19", "<shreddit-post score=3>", 7)], "id string, html string, refreshed_at bigint"),
    )
    reports = run_stage(store, jobs, landed, 20 * DAY, exports=out, refresh=True, window_days=1)
    assert set(reports) == {"backfill", "threads", "refresh", "export", "stats"}
    total = reports["stats"].where("is_overall = 1").first()
    assert (total.posts, total.comments, total.comment_trees) == (20, 40, 1)
    assert [r.subreddit for r in store.read("subreddit_meta").collect()] == ["PY"]
    assert [(r.id, r.live_score) for r in reports["refresh"].collect()] == [("p19", 3)]
    assert set(run_stage(store, jobs, landed, 20 * DAY, "stats")) == {"stats"}
    assert set(run_stage(store, jobs, landed, 20 * DAY, "threads")) == {"threads", "stats"}
    assert set(run_stage(store, jobs, landed, 20 * DAY, "export", out)) == {"export"}
    with pytest.raises(ValueError):
        run_stage(store, jobs, landed, 0, "other")


def test_expand_requests(spark):
    rows = [
        (" python, rust,,golang ", "90d", "now", True, False, False, True),
        ("x", "now", "2020-01-01", True, True, True, True),
        ("x", "bad", None, True, True, True, True),
        ("", None, None, True, True, True, True),
    ]
    jobs = spark.createDataFrame(
        rows,
        "subreddits string, since_spec string, until_spec string, fetch_posts boolean, "
        "fetch_comments boolean, fetch_trees boolean, fetch_meta boolean",
    )
    now = 1_750_000_000
    got = sorted(tuple(r) for r in expand_requests(jobs, now).collect())
    assert got == sorted(
        (s, k, now - 90 * DAY, now) for s in ("python", "rust", "golang") for k in ("posts", "meta")
    )


# Streams


def land(folder, name, *rows):
    folder = folder / "subreddit=Py"
    folder.mkdir(parents=True, exist_ok=True)
    text = "".join(json.dumps({"id": i, "created_utc": t, "link_id": "t3_p", "body": b}) + "\n" for i, t, b in rows)
    (folder / name).write_text(text)


def stored(store):
    return {r.id: r.body for r in store.read("comments").collect()}


def follow(spark, store, tmp_path, checkpoint="check", **how):
    query = follow_tail(store, str(tmp_path / "landed"), "comments", str(tmp_path / checkpoint), 1, **how)
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    store, landed = Store(spark, str(tmp_path / "store")), tmp_path / "landed"
    land(landed, "1.jsonl", ("a", 1, "first"), ("b", 2, "b"), ("a", 3, "copy"))
    follow(spark, store, tmp_path, maxFilesPerTrigger=1)
    assert stored(store) == {"a": "first", "b": "b"}
    land(landed, "2.jsonl", ("b", 9, "copy"), ("c", 4, "c"))
    land(landed, "3.jsonl", ("c", 4, "copy"), ("d", 5, "d"))
    follow(spark, store, tmp_path, maxFilesPerTrigger=1)
    expected = {"a": "first", "b": "b", "c": "c", "d": "d"}
    assert stored(store) == expected
    # A lost checkpoint reads every file again.
    follow(spark, store, tmp_path, checkpoint="fresh")
    assert stored(store) == expected and store.read("comments").count() == 4

    batch = Store(spark, str(tmp_path / "batch"))
    rows = normalize_comments(
        landed_records(spark, str(landed)), F.col("subreddit"), 1, keep=tuple(ARRIVAL)
    )
    batch.append("comments", fresh_records(rows, batch.read("comments"), ARRIVAL))
    assert stored(batch) == expected


def test_late_records_are_not_revisited(spark, tmp_path):
    covered = spark.createDataFrame([("py", "comments", 0, 100, 0)], COVERED)
    land(tmp_path / "landed", "1.jsonl", ("late", 95, "x"), ("edge", 100, "x"), ("new", 101, "x"))
    strict, overlap = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    follow(spark, strict, tmp_path, "c1", covered=covered)
    assert set(stored(strict)) == {"edge", "new"}
    follow(spark, overlap, tmp_path, "c2", covered=covered, lateness=10)
    assert set(stored(overlap)) == {"late", "edge", "new"}


def test_stream_sets_aside_what_no_window_holds(spark, tmp_path):
    """Six lines under a cover ending at 500: each is stored or set aside with a reason."""
    folder = tmp_path / "landed" / "subreddit=Py"
    folder.mkdir(parents=True)
    (folder / "1.jsonl").write_text(
        '{"id": "n", "created_utc": null}\n{"id": "t", "created_utc": "soon"}\nnot json\n'
        '{"id": "us", "created_utc": 1700000000000000}\n{"id": "old", "created_utc": 499}\n'
        '{"id": "new", "created_utc": 500}\n{"created_utc": 501}\n'
    )
    covered = spark.createDataFrame([("py", "comments", 0, 500, 0)], COVERED)
    for name, cover in (("a", covered), ("b", None)):
        store = Store(spark, str(tmp_path / name))
        for check in ("one", "two"):  # a lost checkpoint changes nothing
            follow(spark, store, tmp_path, f"{name}-{check}", covered=cover)
        assert set(stored(store)) == ({"new"} if cover else {"new", "old"})
        aside = spark.read.parquet(str(tmp_path / name / "no_id" / "comments")).collect()
        reasons = ["no id", "no json", "no time", "no time", "time out of range"]
        assert sorted(r.reason for r in aside) == reasons


def tail(spark, store, tmp_path, now, **how):
    return run_tail(store, str(tmp_path / "landed"), "comments", str(tmp_path / "check"), now, **how)


def test_a_tail_advances_the_cover(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.change("covered_range", spark.createDataFrame([("py", "comments", 0, 100, 0), ("go", "comments", 0, 100, 0)], COVERED))
    land(tmp_path / "landed", "1.jsonl", ("late", 95, "x"), ("edge", 100, "x"))
    land(tmp_path / "landed", "2.jsonl", ("new", 400, "x"), ("edge", 100, "copy"))
    assert tail(spark, store, tmp_path, 500, maxFilesPerTrigger=1) == {"lines": 4, "fresh": 2, "problems": 0}
    assert set(stored(store)) == {"edge", "new"}
    found = {r.subreddit: (r.since, r.until, r.updated_at) for r in store.read("covered_range").collect()}
    assert found == {"py": (0, 500, 500), "go": (0, 100, 0)}  # no file of the other one was followed
    # Stream, then backfill: nothing is missing.
    source = landed_archive(spark, str(tmp_path / "landed"), "comments")
    asked = spark.createDataFrame([("py", "comments", 0, 500)], REQUESTS)
    assert report(run_backfill(store, source, asked, 600, ARRIVAL)) == {}
    # A run that finds no new file has still looked: the cover moves on, and never back.
    for now, until in ((700, 700), (650, 700)):
        assert tail(spark, store, tmp_path, now)["lines"] == 0
        assert {r.until for r in store.read("covered_range").where("subreddit = 'py'").collect()} == {until}
    land(tmp_path / "landed", "3.jsonl", ("c", 750, "x"), ("slow", 690, "x"))
    tail(spark, store, tmp_path, 800, lateness=20)
    assert set(stored(store)) == {"edge", "new", "c", "slow"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """A batch that died before its entry is done again, one that died after it is skipped."""
    store = Store(spark, str(tmp_path / "store"))
    store.change("covered_range", spark.createDataFrame([("py", "comments", 0, 100, 0)], COVERED))
    land(tmp_path / "landed", "1.jsonl", ("a", 100, "x"), ("b", 200, "x"))
    (tmp_path / "landed" / "subreddit=Py" / "0.jsonl").write_text("no json\n")
    finish = type(store.commits).finish

    def before(*_):
        raise RuntimeError("lost")

    def after(*how):
        finish(*how)
        raise RuntimeError("lost")

    for dies in (before, after):
        with monkeypatch.context() as m:
            m.setattr(type(store.commits), "finish", dies)
            with pytest.raises(Exception):
                tail(spark, store, tmp_path, 500)
        assert covers(store) == {"comments": (0, 100)}  # not before all that had landed is loaded
    appends = []
    with monkeypatch.context() as m:
        m.setattr(Store, "append", lambda *how: appends.append(how))
        tail(spark, store, tmp_path, 600)
    assert appends == [] and set(stored(store)) == {"a", "b"} and store.read("comments").count() == 2
    assert covers(store) == {"comments": (0, 600)}
    assert spark.read.parquet(str(tmp_path / "store" / "no_id" / "comments")).count() == 1


def test_watermark_dedup(spark, tmp_path):
    land(tmp_path / "landed", "1.jsonl", ("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x"))
    stream = landed_records(spark, str(tmp_path / "landed"), stream=True)
    rows = normalize_comments(stream, F.col("subreddit"), 1)
    query = (
        dedup_within_watermark(rows, "1 hour").writeStream.format("memory").queryName("deduped")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.id for r in spark.table("deduped").collect()) == ["a", "b"]


def test_month_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    run_backfill(store, archive(spark), ask(spark, 0, 60 * DAY), 5, ["arrival"])
    wrong = store.read("posts").where(F.col("created_month") != month_of_epoch("created_utc"))
    assert wrong.count() == 0


def test_times_that_no_number_holds_are_set_aside(spark, tmp_path):
    from threadlake.sources.archive import landed_archive

    times = {"NaN": "no time", "Infinity": "no time", "1e33": "time out of range", "9e18": "time out of range",
             "x": "no time", "-5": "time out of range", "1700000000.5": None, "1.7e9": None}
    lines = [f'{{"id": "{i}", "subreddit": "s", "created_utc": "{t}"}}' for i, t in enumerate(times)]
    (tmp_path / "landed.jsonl").write_text("\n".join(lines))
    rows = landed_archive(spark, str(tmp_path / "landed.jsonl"), "comments").collect()
    assert {r.id: r.problem for r in rows} == {str(i): p for i, p in enumerate(times.values())}
