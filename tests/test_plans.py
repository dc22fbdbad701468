"""Physical plans: what is filtered at the scan, combined before a shuffle, or never joined."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadlake.functions import month_of_epoch
from threadlake.operators.coverage import incremental_load
from threadlake.operators.dedup import first_wins
from threadlake.operators.membership import absent_from, existing_ids
from threadlake.operators.normalize import normalize_posts
from threadlake.operators.upsert import fresh_records
from threadlake.plans.queries import QUERIES
from threadlake.scratch import write_table
from threadlake.sources import Store, scan_window
from threadlake.sources.sliced import read_slice, write_slices

# §2.14 of the blueprint, and two more shapes.
KEYS = """
scan_posts_page scan_comments_page scan_window subreddit_meta missing_trees merge_trees
rows_by_subreddit comments_grouped page_attr_extract csv_posts csv_comments thread_json
normalize_posts normalize_comments refresh_worklist refresh_outcome expand_requests existing_ids
fresh_records upsert_posts upsert_comments has_tree_flag thread_parents thread_orphans coverage_plan
incremental_load merge_live_counts shard_assign coverage_commit stats_overall stats_by_subreddit
stats_rollup ingest_report dedup_first_wins thread_totals csv_counts thread_nodes sibling_rank
thread_unplaced shard_bounds keyset_pages refresh_topk strip_fullname parent_kind timespec_parse
request_windows epoch_date parse_counts json_path_default json_roundtrip late_records
refresh_totals thread_chains set_aside_rows slice_plan
""".split()


@pytest.fixture(autouse=True, scope="module")
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_key_is_registered():
    assert set(QUERIES) == set(KEYS) and set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("name", KEYS)
def test_no_cross_join_no_python_no_single_task(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|InArrow", text)
    if name not in ("stats_overall", "slice_plan"):  # three counts; a row per day
        assert "SinglePartition" not in text


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    rows = spark.range(2000).select(
        F.concat(F.lit('{"id": "'), F.col("id").cast("string"), F.lit('", "created_utc": '),
                 (F.col("id") * 86400).cast("string"), F.lit("}")).alias("value")
    )
    store.append("posts", normalize_posts(rows, F.lit("Py"), 0))
    return store


def test_window_scan_skips_folders_and_row_groups(store):
    text = plan(scan_window(store.read("posts"), ["PY"], 100 * 86400, 130 * 86400).select("id"))
    partition = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text).group(1)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "created_month" in partition
    assert "EqualTo(community,py)" in pushed and "GreaterThanOrEqual(created_utc" in pushed
    assert re.search(r"ReadSchema: struct<id:string,created_utc:bigint,community:string>", text)


def test_dedup_keeps_one_copy_before_the_shuffle(spark):
    rows = write_table(spark.range(10).withColumn("t", F.col("id") % 3), "rows")
    text = plan(first_wins(rows, ["id"], ["t"]))
    partial = text.index("Partial")
    assert text.index("Final") < text.index("Exchange") < partial


def test_fresh_records_shuffle_the_batch_once(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("t"))
        text = plan(fresh_records(batch, store.read("posts"), ["t"]))
        assert text.count("Exchange hashpartitioning") == 2
        assert "ReadSchema: struct<id:string>" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_a_small_batch_does_not_shuffle_the_store(spark, store):
    batch = write_table(spark.range(10).select(F.col("id").cast("string").alias("id")), "batch")
    text = plan(existing_ids(batch, store.read("posts")))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "SortMergeJoin" not in plan(absent_from(batch, store.read("posts"), probe=True))


def test_incremental_load_prunes_month_folders(spark, store):
    windows = write_table(
        spark.createDataFrame(
            [("py", "posts", "tail", 100 * 86400, 130 * 86400)],
            "subreddit string, kind string, window_type string, since bigint, before bigint",
        ),
        "plan",
    )
    archive = store.read("posts").withColumn("kind", F.lit("posts"))
    loaded = incremental_load(archive, windows)
    assert loaded.count() == 30
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", plan(loaded))


def test_records_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"id": "a"}', 1)], "value string, t int")
    rows = normalize_posts(raw, F.lit("s"), 0, keep=("t",)).where(F.col("score") > 0)
    assert plan(first_wins(rows, ["id"], ["t"])).count("from_json") == 1


def test_trees_and_reports_are_not_sorted(spark, small):
    for name in ("merge_trees", "ingest_report"):
        assert "SortAggregate" not in plan(entry.queries()[name](spark, small))


def test_totals_carry_no_paths_and_pages_are_passed_once(spark, small):
    assert not re.search(r"\bpath#|array<struct", plan(entry.queries()["thread_totals"](spark, small)))
    text = plan(entry.queries()["page_attr_extract"](spark, small))
    assert text.count("regexp_extract_all(html") == 1 and "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_one_slice_reads_its_own_files(spark, tmp_path):
    rows = spark.range(5000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 90).otherwise(F.col("id") % 10).alias("day"),
    )
    rows = rows.withColumn("created_utc", F.col("day") * 86400 + F.col("id") % 1000)
    slices = write_slices(rows, str(tmp_path), 3 * 86400, 80 * 86400, 4).orderBy("slice").collect()
    assert slices[0].start == 3 * 86400 and slices[-1].end == 80 * 86400
    assert [s.end for s in slices[:-1]] == [s.start for s in slices[1:]]
    inside = rows.where(f"created_utc >= {3 * 86400} and created_utc < {80 * 86400}")
    assert sum(s.n_rows for s in slices) == inside.count()
    for s in slices:
        found = read_slice(spark, str(tmp_path), s.slice)
        assert sorted(r.id for r in found.collect()) == sorted(
            r.id for r in inside.where(f"created_utc >= {s.start} and created_utc < {s.end}").collect()
        )
    text = plan(read_slice(spark, str(tmp_path), slices[1].slice))
    assert re.search(rf"PartitionFilters: \[[^]]*\(slice#\d+ = {slices[1].slice}\)", text)
    files = read_slice(spark, str(tmp_path), 1).select(F.input_file_name().alias("f")).distinct()
    assert all("slice=1/" in r.f for r in files.collect())
    assert write_slices(rows.limit(0), str(tmp_path / "none"), 0, 10, 3).count() == 0


def test_months_of_a_window(spark):
    months = spark.range(1).select(month_of_epoch(F.lit(0)), month_of_epoch(F.lit(31 * 86400)))
    assert tuple(months.first()) == (0, 1)
