"""Scans over landed archive files and stored tables.

A window is half open: ``since <= created_utc < before``. Communities match whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import int_or_zero, line_problem, month_of_epoch

# Order in which landed lines arrived: file by file, then along the file.
ARRIVAL = ["file_time", "file_path", "block_start", "line_place"]


def landed_records(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Landed JSON lines, one record per row in ``value``, with the columns of ARRIVAL.

    Lines are kept whole. A folder below ``path`` named ``subreddit=<name>`` becomes the
    ``subreddit`` column. A stream cannot number lines: its micro-batches are given to
    ``with_line_place``.
    """
    reader = (spark.readStream if stream else spark.read).options(**options)
    if "subreddit" in spark.read.text(path).columns:  # else a name of digits would be a number
        reader = reader.schema("value string, subreddit string")
    lines = reader.text(path)
    records = lines.where(F.trim("value") != "").select(
        *lines.columns,
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    return records if stream else with_line_place(records)


def with_line_place(records: DataFrame) -> DataFrame:
    """Number lines; only compared between lines of one file block, which one task reads."""
    return records.withColumn("line_place", F.monotonically_increasing_id())


def placed_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Landed lines of one kind (``value``, the columns of ARRIVAL, and the folder's ``subreddit`` if
    there is one) as an archive to load from: kind, subreddit, created_utc, id, value, problem and the
    columns of ARRIVAL. Batches of a stream and whole archives are read alike.

    The community is the record's own, or that of its folder. The time is taken as stored rows
    take it. ``problem`` says why a line can be placed in no window (``line_problem``).
    """
    folder = F.col("subreddit") if "subreddit" in lines.columns else F.lit(None).cast("string")
    fields = F.from_json("value", "id string, subreddit string, created_utc string")
    records = lines.select(folder.alias("_folder"), "value", *ARRIVAL, F.explode(F.array(fields)).alias("_r"))
    community = F.coalesce(F.nullif(F.col("_r.subreddit"), F.lit("")), "_folder")
    return records.select(
        F.lit(kind).alias("kind"),
        community.alias("subreddit"),
        int_or_zero("_r.created_utc").alias("created_utc"),
        F.col("_r.id").alias("id"),
        "value",
        *ARRIVAL,
        line_problem("value", "_r.created_utc", community).alias("problem"),
    )


def landed_archive(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A landed folder as an archive, read and parsed anew by every job that uses it. ``Landing``
    converts each file once instead."""
    return placed_lines(landed_records(spark, path), kind)


def spread(records: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than cores (a gzip dump, one row group) over all cores.

    An input with enough splits stays as it is, without a shuffle.
    """
    cores = records.sparkSession.sparkContext.defaultParallelism
    return records.repartition(cores) if records.rdd.getNumPartitions() < cores else records


def _of_community(records: DataFrame, names: list[str]) -> Column:
    """The store keeps the lower-case name as ``community``, which the file scan can filter on."""
    key = F.col("community") if "community" in records.columns else F.lower("subreddit")
    return key.isin([n.lower() for n in names])


def _in_window(records: DataFrame, since: int, before: int) -> Column:
    inside = (F.col("created_utc") >= since) & (F.col("created_utc") < before)
    if "created_month" in records.columns:  # month folders: skips whole folders
        months = month_of_epoch(F.lit(since)), month_of_epoch(F.lit(before - 1))
        inside = inside & F.col("created_month").between(*months)
    return inside


def scan_window(records: DataFrame, subreddits: list[str], since: int, before: int) -> DataFrame:
    """All records of the communities in the window; the filters reach the file scan."""
    return records.where(_of_community(records, subreddits) & _in_window(records, since, before))


def scan_page(
    records: DataFrame,
    subreddit: str,
    since: int,
    before: int,
    limit: int = 100,
    sort: str = "asc",
) -> DataFrame:
    """The first ``limit`` records of the window in time order (a top-k, not a full sort)."""
    order = ["created_utc", "id"]
    keys = [F.col(c).desc() if sort == "desc" else F.col(c).asc() for c in order]
    return scan_window(records, [subreddit], since, before).orderBy(*keys).limit(limit)


def rows_by_subreddit(table: DataFrame, subreddit: str) -> DataFrame:
    """Stored rows of a community, oldest first (range partitioned sort)."""
    return table.where(_of_community(table, [subreddit])).orderBy("created_utc", "id")


def thread_scan(comments: DataFrame, subreddit: str) -> DataFrame:
    """Comments of a community with those of one post together, oldest first.

    The order is over the whole table, so even one huge post is split over several tasks.
    """
    return (
        comments.where(_of_community(comments, [subreddit]))
        .select("link_id", "created_utc", "id", "archive_json")
        .orderBy("link_id", "created_utc", "id")
    )
