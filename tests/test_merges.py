from pyspark.sql import functions as F

from threadlake.operators.dedup import first_wins, last_wins, without_id
from threadlake.operators.membership import absent_from, existing_ids
from threadlake.operators.normalize import normalize_comments, normalize_meta, normalize_posts
from threadlake.operators.stats import stats_overall
from threadlake.operators.upsert import fresh_records, merge_meta, merge_trees, upsert


def ids(df):
    return sorted(r.id for r in df.collect())


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, body string, arrival bigint")


def test_only_unknown_ids_are_fresh_and_stored_rows_stay(spark):
    landed = batch(spark, ("oak", "new", 3), ("elm", "first", 1), ("elm", "second", 2), ("yew", "new", 4))
    stored = batch(spark, ("oak", "kept", 0), ("fir", "kept", 0)).select("id", "body")
    for probe in (False, True):
        fresh = fresh_records(landed, stored, ["arrival"], probe)
        assert {r.id: r.body for r in fresh.collect()} == {"elm": "first", "yew": "new"}
    merged = upsert(stored, landed, ["arrival"])
    expected = {"oak": "kept", "fir": "kept", "elm": "first", "yew": "new"}
    assert {r.id: r.body for r in merged.collect()} == expected and merged.count() == 4
    assert fresh_records(landed, merged, ["arrival"]).count() == 0
    assert ids(fresh_records(landed, stored.limit(0), ["arrival"])) == ["elm", "oak", "yew"]


def test_ids_asked_of_the_store(spark):
    stored = batch(spark, *[(f"s{n}", "", n) for n in range(0, 30, 3)])
    asked = batch(spark, *[(f"s{n % 30}", "", n) for n in range(0, 60, 2)])
    assert ids(existing_ids(asked, stored)) == sorted(f"s{n}" for n in range(0, 30, 6))
    assert sorted({i for i in ids(absent_from(asked, stored, probe=True))}) == sorted(
        f"s{n}" for n in range(0, 30, 2) if n % 3
    )
    assert ids(existing_ids(batch(spark), stored)) == []


def test_first_and_last_wins(spark):
    rows = batch(spark, ("a", "2", 2), ("a", "1", 1), ("a", "3", 3), ("b", "x", 9), (None, "n", 1), (None, "m", 2))
    assert {r.id: r.body for r in first_wins(rows, ["id"], ["arrival"]).collect()} == {"a": "1", "b": "x"}
    assert {r.id: r.body for r in last_wins(rows, ["id"], ["arrival"]).collect()} == {"a": "3", "b": "x"}
    assert without_id(rows).count() == 2


def test_one_id_with_most_rows(spark):
    copies = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("id"),
        F.col("id").alias("arrival"),
    )
    kept = first_wins(copies, ["id"], ["arrival"])
    assert kept.count() == 6668
    assert kept.where("id = 'hot'").first().arrival == 1


def test_normalize_posts(spark):
    raw = spark.createDataFrame(
        [
            ('{"id": "p1", "created_utc": 100, "title": "tp1", "score": 1, "num_comments": 0}',),
            ('{"id": 7, "subreddit": "Own", "created_utc": "17", "is_self": true, "author": null}',),
            ("not json",),
        ],
        "value string",
    )
    rows = {r.id: r for r in normalize_posts(raw, F.lit("test"), 5).collect()}
    assert (rows["p1"].subreddit, rows["p1"].created_utc, rows["p1"].num_comments) == ("test", 100, 0)
    assert (rows["p1"].is_self, rows["p1"].url, rows["p1"].fetched_at) == (0, None, 5)
    assert (rows["7"].subreddit, rows["7"].created_utc, rows["7"].is_self) == ("Own", 17, 1)
    assert rows[None].created_utc == 0


def test_normalize_comments_keeps_the_raw_record(spark):
    text = '{"id": "c1", "link_id": "t3_p1",  "parent_id": "t3_p1", "created_utc": 100, "body": "hé \\"x\\""}'
    row = normalize_comments(spark.createDataFrame([(text,)], "value string"), F.lit("s"), 0).first()
    assert row.archive_json == text and row.body == 'hé "x"'


def test_meta_round_trip(spark):
    text = (
        '{"display_name": "test", "subscribers": 1234, "created_utc": 1600000000, '
        '"public_description": "desc"}'
    )
    raw = spark.createDataFrame(
        [("test", text, 2, 0), ("test", "{}", 2, 1), ("test", "{}", 1, 0)],
        "subreddit string, value string, response bigint, place bigint",
    )
    rows = merge_meta(normalize_meta(raw, "subreddit", 0, keep=("response", "place"))).collect()
    assert len(rows) == 1
    assert (rows[0].subscribers, rows[0].created_utc, rows[0].public_description) == (1234, 1600000000, "desc")


def test_merge_trees(spark):
    layout = "link_id string, subreddit string, tree_json string, fetched_at bigint"
    stored = spark.createDataFrame([("a", "S", "[1]", 1), ("b", "S", "[2]", 1)], layout)
    new = spark.createDataFrame(
        [("a", "other", "[9]", 3, 2), ("a", "other", "[8]", 2, 1), ("c", "T", "[3]", 2, 1)],
        layout + ", seq bigint",
    )
    got = {r.link_id: tuple(r)[1:] for r in merge_trees(stored, new).collect()}
    assert got == {"a": ("S", "[9]", 3), "b": ("S", "[2]", 1), "c": ("T", "[3]", 2)}


def test_stats(spark):
    one = spark.createDataFrame([("s",)], "subreddit string")
    assert tuple(stats_overall(one, one, one.limit(0)).first()) == (1, 1, 0)
