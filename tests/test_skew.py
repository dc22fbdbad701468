import pytest
from pyspark.sql import functions as F

from threadlake.operators import skew
from threadlake.operators.stats import ingest_report, late_records
from threadlake.scratch import write_table
from threadlake.streaming import tail_rows


def skewed(spark, n=2000):
    """A third of the rows share one key, and some have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))
    )
    return write_table(
        spark.range(n).select(key.alias("key"), F.pmod(F.col("id") * 7919, F.lit(101)).alias("t"), "id"), "skewed"
    )


def test_hot_keys(spark):
    df = skewed(spark)
    assert [r.key for r in skew.hot_keys(df, ["key"], 100).collect()] == ["hot"]
    assert skew.hot_keys(df, ["key"], 5000) is None
    assert skew.hot_keys(df, ["key"], 1000) is None


MOST = pytest.mark.parametrize("most", [20_000, 2])  # hot keys told apart by a broadcast, or not


@MOST
def test_rank_is_the_same_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", most)
    df = skewed(spark)
    plain = skew.rank_in_groups(df, ["key"], ["t", "id"], "r")
    split = skew.rank_in_groups(df, ["key"], ["t", "id"], "r", hot_rows=20)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


@MOST
def test_neighbours_are_the_same_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", most)
    df = skewed(spark)
    rows = sorted((r.key or "", r.t, r.id) for r in df.collect())
    expected = {i: (b[2] if b and b[0] == k else None, not a or a[0] != k)
                for b, (k, _, i), a in zip([None, *rows], rows, [*rows[1:], None])}
    for hot_rows in (1_000_000, 20):
        found = skew.neighbours_in_groups(df, ["key"], ["t", "id"], "id", hot_rows)
        assert {r.id: (r._before, r._is_last) for r in found.collect()} == expected


@MOST
def test_lookup_is_the_same_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", most)
    df = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("nowhere", 3)], "key string, v int")
    for how in ("left", "inner"):
        plain = df.join(right, "key", how)
        split = skew.lookup(df, right, ["key"], how, hot_rows=20)
        assert split.columns == plain.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_counts_with_a_hot_community(spark):
    rows = skewed(spark).select(
        F.coalesce("key", F.lit("none")).alias("subreddit"), F.lit("posts").alias("kind"),
        (F.col("id") % 500).cast("string").alias("id"), F.col("t").alias("created_utc"),
    )
    store = spark.createDataFrame([("posts", "0"), ("posts", "3"), ("comments", "6")], "kind string, id string")
    report = ingest_report(rows, store).agg(F.sum("fetched"), F.sum("distinct_ids"), F.sum("new_rows")).first()
    # An id counts once in each community that has it.
    pairs = rows.select("subreddit", "id").distinct()
    new = pairs.where(~F.col("id").isin("0", "3")).count()
    assert tuple(report) == (2000, pairs.count(), new)
    lost = rows.withColumn("id", F.when(F.col("id") != "7", F.col("id")))
    assert ingest_report(lost, store).agg(F.sum("fetched")).first()[0] == 2000
    covered = rows.groupBy("subreddit").agg(F.lit(50).cast("bigint").alias("until"))
    expected = rows.where("created_utc < 50").count()
    assert late_records(rows, covered).count() == expected
    assert late_records(rows, covered, hot_rows=20).count() == expected
    assert tail_rows(rows, covered, hot_rows=20).count() == 2000 - expected
    assert tail_rows(rows, covered, lateness=10).count() == rows.where("created_utc >= 40").count()
