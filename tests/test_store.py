"""Versioned tables, the id index and the landing of files."""

import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from threadlake.operators.coverage import changed_covers, incremental_load, tail_commit, widest_covers
from threadlake.operators.normalize import normalize_comments
from threadlake.plans.backfill import Exports, run_backfill, run_threads, run_trees
from threadlake.schemas import COVERED, REQUESTS
from threadlake.scratch import write_table
from threadlake.sources import Landing, Store, id_index
from threadlake.sources.archive import ARRIVAL
from threadlake.sources.id_index import IdIndex
from threadlake.sources.versions import MOST_CHANGES, VersionedTable, latest_by_key

DAY = 86400
LAYOUT = "k string, v bigint"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def versioned(spark, tmp_path):
    layout = spark.createDataFrame([], LAYOUT).schema
    return VersionedTable(spark, str(tmp_path / "table"), layout, ["k"])


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_replace_whole_keys(spark, versioned):
    assert rows_of(versioned.read()) == []
    state, rng = {}, random.Random(1)
    for step in range(8):
        rows = [(f"k{rng.randrange(12)}", rng.randrange(9)) for _ in range(rng.randrange(1, 8))]
        made = {}
        for k, v in rows:
            made.setdefault(k, []).append(v)
        df = spark.createDataFrame(rows, LAYOUT)
        if step == 3:
            versioned.replace(df)
            state = made
        else:
            versioned.change(df)
            state |= made
        assert rows_of(versioned.read()) == sorted((k, v) for k, vs in state.items() for v in vs)
        if step == 5:
            versioned.compact()
            assert [p["base"] for p in versioned.parts()] == [True]


def test_a_change_writes_only_its_rows(spark, versioned):
    versioned.replace(spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")))
    versioned.change(spark.createDataFrame([("5", -5), ("x", 1)], LAYOUT))
    *_, last = versioned.parts()
    assert spark.read.parquet(f"{versioned.folder}/data/{last['name']}").count() == 2
    found = versioned.read()
    assert found.count() == 1001 and found.where("k = '5'").first().v == -5
    # Merged when read: the base is neither sorted nor aggregated.
    text = plan(found)
    assert "Sort" not in text and "BroadcastHashJoin" in text


def test_old_versions_go_and_read_ones_stay(spark, versioned):
    for i in range(MOST_CHANGES + 3):
        versioned.change(spark.createDataFrame([("k", i), (f"k{i}", i)], LAYOUT))
    parts = versioned.parts()
    assert len(parts) < MOST_CHANGES and parts[0]["base"]
    versioned.expire(keep=1)
    assert len(versioned.versions()) == 1
    kept = set(versioned._files.names(f"{versioned.folder}/data"))
    assert kept == {p["name"] for p in versioned.parts()}
    assert versioned.read().count() == MOST_CHANGES + 4
    assert versioned.read().where("k = 'k'").first().v == MOST_CHANGES + 2


def test_two_writers_at_once_lose_nothing(spark, versioned):
    """Both begin with the same version; the loser of the number comes behind the winner."""
    errors, gate = [], threading.Barrier(4)

    def write(n):
        try:
            df = spark.createDataFrame([(f"k{n}", n)], LAYOUT)
            gate.wait()
            versioned.change(df)
        except Exception as e:  # told to the main thread
            errors.append(e)

    workers = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert not errors
    assert rows_of(versioned.read()) == [(f"k{n}", n) for n in range(4)]
    assert not versioned._files.create(versioned._manifest(1), "{}")


def test_compaction_keeps_what_was_changed_meanwhile(spark, versioned, monkeypatch):
    for i in range(3):
        versioned.change(spark.createDataFrame([("a", i), (f"b{i}", i)], LAYOUT))
    write = VersionedTable._write

    def slow(self, rows, base):
        part = write(self, rows, base)
        if base:
            monkeypatch.setattr(VersionedTable, "_write", write)
            versioned.change(spark.createDataFrame([("a", 99)], LAYOUT))
        return part

    monkeypatch.setattr(VersionedTable, "_write", slow)
    versioned.compact()
    assert [p["base"] for p in versioned.parts()] == [True, False]
    assert rows_of(versioned.read()) == [("a", 99), ("b0", 0), ("b1", 1), ("b2", 2)]


def test_latest_by_key_without_a_base(spark):
    one, two = (spark.createDataFrame(r, LAYOUT) for r in ([("a", 1), ("a", 2), ("b", 1)], [("a", 3)]))
    assert rows_of(latest_by_key(None, [one, two], ["k"])) == [("a", 3), ("b", 1)]


def test_covers_of_two_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    cover = lambda *r: spark.createDataFrame(r, COVERED)
    store.change("covered_range", cover(("py", "posts", 100, 200, 1), ("go", "posts", 0, 50, 1)))
    # One run has gone further back, the other one further on.
    store.change("covered_range", cover(("py", "posts", 10, 200, 2)))
    store.change("covered_range", cover(("py", "posts", 100, 300, 3)))
    assert rows_of(store.read("covered_range")) == [("go", "posts", 0, 50, 1), ("py", "posts", 10, 300, 3)]
    before, after = cover(("a", "posts", 1, 2, 0)), cover(("a", "posts", 1, 2, 9), ("b", "posts", 1, 2, 9))
    assert [r.subreddit for r in changed_covers(after, before).collect()] == ["b"]
    assert widest_covers(cover()).count() == 0
    grown = tail_commit(spark.createDataFrame([("PY",), ("new",)], "subreddit string"), cover(("py", "posts", 1, 5, 0), ("go", "posts", 1, 5, 0)), "posts", 9, 7)
    assert rows_of(grown) == [("py", "posts", 1, 9, 7)]


# Ids


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "id string")


def test_known_ids(spark, tmp_path):
    index, rng = IdIndex(spark, str(tmp_path / "ids")), random.Random(2)
    stored = set()
    for size in (500, 1, 60):
        new = {f"é{rng.randrange(10**6)}" for _ in range(size)} - stored
        index.add(ids(spark, new))
        stored |= new
    asked = list(stored)[:40] + [f"new{i}" for i in range(200)] + [None, "", "new1"]
    found = sorted(r.id for r in index.known(ids(spark, asked)).collect())
    assert found == sorted(list(stored)[:40])
    assert index.known(ids(spark, [])).count() == 0
    index.compact()
    assert sorted(r.id for r in index.known(ids(spark, asked)).collect()) == found


def test_large_batches_and_sliced_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_index, "SLICE", 3)
    monkeypatch.setattr(id_index, "BUCKETS", 4)
    index = IdIndex(spark, str(tmp_path / "ids"))
    index.add(ids(spark, [str(i) for i in range(300)]))
    asked = ids(spark, [str(i) for i in range(250, 350)])
    assert index.known(asked).count() == 50
    monkeypatch.setattr(id_index, "FILTERED", 10)
    assert index.known(asked).count() == 50


def records(n, start=0):
    return [json.dumps({"id": f"c{i}", "link_id": f"t3_p{i % 7}", "parent_id": f"t3_p{i % 7}", "created_utc": i * DAY}) for i in range(start, start + n)]


def comments(spark, lines):
    raw = spark.createDataFrame([(line,) for line in lines], "value string")
    return write_table(normalize_comments(raw, F.lit("Py"), 1), "rows")


def test_a_small_batch_reads_its_buckets_and_not_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("comments", comments(spark, records(2000)))
    batch = comments(spark, records(3, 1999))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        text = plan(store.known_ids("comments", batch))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    (bucket,) = (r.bucket for r in ids(spark, ["c1999"]).select(id_index.bucket_of().alias("bucket")).collect())
    assert re.search(rf"PartitionFilters: \[[^]]*\(bucket#\d+ = {bucket}\)", text)
    assert "created_month" not in text and "ids/comments/ids" in text
    assert [r.id for r in store.known_ids("comments", batch).collect()] == ["c1999"]


def test_an_append_that_died_leaves_the_index_untrusted(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.append("comments", comments(spark, records(5)))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(IdIndex, "add", dies)
        with pytest.raises(RuntimeError):
            store.append("comments", comments(spark, records(5, 5)))
    batch = comments(spark, records(20))
    assert store.known_ids("comments", batch).count() == 10  # read from the table
    store.append("comments", comments(spark, records(1, 15)))
    assert store._index("comments").is_whole()
    assert store.known_ids("comments", batch).count() == 11


# Landing


def land(folder, name, lines, community="Py"):
    folder = folder / f"subreddit={community}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def ask(spark, since, before):
    return spark.createDataFrame([("py", k, since, before) for k in ("posts", "comments")], REQUESTS)


def test_files_are_converted_once_and_read_by_month(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landing, landed = Landing(store), tmp_path / "landed"
    assert landing.archive().count() == 0
    land(landed, "1.jsonl", [*records(400), "no json", '{"id": "x", "created_utc": null}', records(1)[0]])
    landing.convert("comments", str(landed), 5)
    assert landing.archive().count() == 401
    aside = spark.read.parquet(str(tmp_path / "store" / "no_id" / "comments"))
    assert sorted(r.reason for r in aside.collect()) == ["no json", "no time"]
    land(landed, "2.jsonl", records(10, 400))
    for _ in range(2):  # the second time there is nothing new
        landing.convert("comments", str(landed), 6)
        assert landing.archive().count() == 411
    stream = store.commits.stream_of(landing._checkpoint("comments"))
    assert [c["lines"] for c in store.commits.counts(stream).values()] == [403, 10]

    # A run reads the months of its windows, and parses each loaded record once.
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    windows = write_table(
        spark.createDataFrame([("py", "comments", "full", 100 * DAY, 130 * DAY)], "subreddit string, kind string, window_type string, since bigint, before bigint"),
        "plan",
    )
    loaded = incremental_load(landing.archive(), windows)
    try:
        assert loaded.count() == 30
        text = plan(loaded)
        assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", text) and "from_json" not in text
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    run = run_backfill(store, landing.archive(), ask(spark, 0, 300 * DAY), 7, ARRIVAL)
    assert [(r.fetched, r.distinct_ids, r.new_rows) for r in run.collect()] == [(301, 300, 300)]
    assert store.read("comments").count() == 300


def test_a_conversion_that_died_is_done_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    landing, landed = Landing(store), tmp_path / "landed"
    land(landed, "1.jsonl", [*records(20), "no json"])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(store.commits), "finish", dies)
        with pytest.raises(Exception):
            landing.convert("comments", str(landed), 5)
    assert Landing(store).archive().count() == 0  # written, but not finished
    landing.convert("comments", str(landed), 5)
    assert landing.archive().count() == 20
    assert spark.read.parquet(str(tmp_path / "store" / "no_id" / "comments")).count() == 1


# Threads and trees of what has changed


def run_of(store, spark, lines, now):
    rows = [("comments", "Py", json.loads(x)["created_utc"], json.loads(x)["id"], x, i) for i, x in enumerate(lines)]
    source = spark.createDataFrame(rows, "kind string, subreddit string, created_utc bigint, id string, value string, arrival bigint")
    run_backfill(store, source, ask(spark, 0, now * DAY), now, ["arrival"])


def lines_of(store):
    return sorted((r.link_id, r.pos, r.text) for r in store.read("thread_lines").collect())


def test_only_posts_with_new_comments_are_threaded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run_of(store, spark, records(30), 30)
    first = run_threads(store, None, Exports()).where("is_overall = 1").first()
    assert (first.posts_with_threads, first.comments_total) == (7, 30)
    reply = json.dumps({"id": "late", "link_id": "t3_p3", "parent_id": "t1_c3", "created_utc": 31 * DAY})
    run_of(store, spark, [reply], 32)
    total = run_threads(store, None, Exports()).where("is_overall = 1").first()
    assert (total.posts_with_threads, total.comments_total, total.comments_in_tree) == (7, 31, 31)
    last = store.keyed("thread_lines").parts()[-1]
    written = spark.read.parquet(f"{store.root}/thread_lines/data/{last['name']}")
    assert {r.link_id for r in written.select("link_id").collect()} == {"t3_p3"}
    grown = lines_of(store)
    assert store.touched_posts()[0] == []
    run_threads(store, None, Exports(), rebuild=True)
    assert lines_of(store) == grown
    assert run_threads(store, None, Exports()).where("is_overall = 1").first() == total


def test_posts_of_other_communities_stay_marked(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = comments(spark, records(4)).withColumn("subreddit", F.when(F.col("id") == "c1", "Go").otherwise("Py"))
    store.append("comments", write_table(rows, "rows"))
    go = spark.createDataFrame([("GO",)], "subreddit string")
    assert run_threads(store, go, Exports()).where("is_overall = 0").first().subreddit == "go"
    assert {r.community for r in store.touched_posts()[1].collect()} == {"py"}
    assert run_threads(store, None, Exports()).where("is_overall = 1").first().comments_total == 4


def test_a_run_writes_as_many_trees_as_have_landed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    posts = spark.range(300).select(
        F.col("id").cast("string").alias("id"), F.lit("Py").alias("subreddit"), F.col("id").alias("created_utc")
    )
    layout = {f.name: f.dataType for f in store.read("posts").schema}
    full = posts.select(*[F.col(c) if c in posts.columns else F.lit(None).cast(t).alias(c) for c, t in layout.items() if c not in ("community", "created_month")])
    store.append("posts", write_table(full, "posts"))

    def landed(a, b, text):
        return spark.range(a, b).select(
            F.col("id").cast("string").alias("link_id"), F.lit("py").alias("subreddit"), F.lit(text).alias("tree_json"), F.lit(1).cast("bigint").alias("seq")
        )

    run_trees(store, landed(0, 200, "[1]"), 5)
    run_trees(store, landed(190, 210, "[2]"), 6)
    last = store.keyed("comment_trees").parts()[-1]
    assert spark.read.parquet(f"{store.root}/comment_trees/data/{last['name']}").count() == 10
    trees = store.read("comment_trees")
    assert trees.count() == 210 and trees.where("tree_json = '[2]'").count() == 10
