"""The keyed store: Parquet tables under one folder.

Posts and comments are insert-only, so a run appends its fresh rows. They are laid out by
``created_month`` (a bounded number of folders, unlike one per community) and sorted by
community and time inside a file, which lets month folders and row groups be skipped.
``community`` is the lower-case name that filters and joins use. Their ids are indexed beside them
(``IdIndex``), so that a batch need not scan the table. The other tables (trees, thread lines,
community facts, covers, refreshed counts) change by key: a run writes the rows it changes
(``VersionedTable``).
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from threadlake import schemas
from threadlake.functions import month_of_epoch
from threadlake.operators.coverage import widest_covers
from threadlake.operators.dedup import without_id
from threadlake.operators.live import merge_live_counts
from threadlake.operators.membership import existing_ids
from threadlake.scratch import write_table

from .commits import Commits
from .files import Files
from .id_index import IdIndex
from .versions import VersionedTable

RECORDS = {"posts": schemas.POSTS, "comments": schemas.COMMENTS}
KEYED = {
    "comment_trees": (schemas.COMMENT_TREES, ["link_id"]),
    "thread_lines": (schemas.THREAD_LINES, ["community", "link_id"]),
    "thread_posts": (schemas.THREAD_POSTS, ["community", "link_id"]),
    "subreddit_meta": (schemas.SUBREDDIT_META, ["subreddit"]),
    "live_counts": (
        StructType(
            [f for f in schemas.POSTS if f.name in ("id", "live_score", "live_num_comments", "live_refreshed_at")]
        ),
        ["id"],
    ),
    "covered_range": (schemas.COVERED, ["subreddit", "kind"]),
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/commits")
        self._files = Files(spark)

    def keyed(self, table: str) -> VersionedTable:
        layout, keys = KEYED[table]
        return VersionedTable(self.spark, f"{self.root}/{table}", layout, keys)

    def read(self, table: str) -> DataFrame:
        if table in RECORDS:
            layout = StructType([*RECORDS[table].fields])
            layout = layout.add("community", StringType()).add("created_month", IntegerType())
            return self._read(f"{self.root}/{table}", layout)
        if table == "covered_range":
            # Two runs at once each vouch for what they have loaded beside the cover they began with.
            return widest_covers(self.keyed(table).read_all())
        return self.keyed(table).read()

    def append(self, table: str, fresh: DataFrame) -> None:
        """Append rows whose ids are not stored yet, and index their ids; ``fresh`` is written.

        The mark of an append in progress outlives a run that dies, and the index is not trusted
        until it is made anew.
        """
        columns = RECORDS[table].names
        index = self._index(table)
        if not index.is_whole():
            index.rebuild(self.read(table).select("id"))
        mark = index.begin()
        if table == "comments":
            self._touch(fresh.select(F.lower("subreddit").alias("community"), "link_id").distinct())
        rows = fresh.select(
            *columns,
            F.lower("subreddit").alias("community"),
            month_of_epoch("created_utc").alias("created_month"),
        )
        (
            rows.repartitionByRange("created_month", "community", "created_utc", "id")
            .sortWithinPartitions("created_month", "community", "created_utc", "id")
            .write.mode("append")
            .partitionBy("created_month")
            .parquet(f"{self.root}/{table}")
        )
        index.add(fresh.select("id"))
        index.end(mark)

    # Posts whose threads are out of date: marked before their comments are stored, so none is missed.

    def _touch(self, posts: DataFrame) -> None:
        posts = posts.where(F.col("link_id").isNotNull())
        posts.write.parquet(f"{self.root}/touched/{uuid.uuid4().hex}")

    def touched_posts(self) -> tuple[list[str], DataFrame]:
        """Marks, and the posts (community, link_id) they name."""
        marks = [n for n in self._files.names(f"{self.root}/touched") if n[0] not in "._"]
        paths = [f"{self.root}/touched/{m}" for m in marks if self._exists(f"{self.root}/touched/{m}/_SUCCESS")]
        layout = "community string, link_id string"
        rows = self.spark.read.schema(layout).parquet(*paths) if paths else self.spark.createDataFrame([], layout)
        return marks, rows.distinct()

    def untouch(self, marks: list[str], still: DataFrame) -> None:
        """Drop marks whose posts are done, but for those ``still`` to do."""
        if marks and not still.isEmpty():
            self._touch(still)
        for mark in marks:
            self._files.delete(f"{self.root}/touched/{mark}")

    def _index(self, table: str) -> IdIndex:
        return IdIndex(self.spark, f"{self.root}/ids/{table}")

    def known_ids(self, table: str, batch: DataFrame) -> DataFrame:
        """Ids of ``batch`` that are stored. The table is only scanned where its index is not whole
        (an append that died, or one that is under way)."""
        if not self._files.exists(f"{self.root}/{table}"):
            return self.spark.createDataFrame([], "id string")
        index = self._index(table)
        return index.known(batch) if index.is_whole() else existing_ids(batch, self.read(table))

    def set_aside(self, table: str, rows: DataFrame, arrival: list[str]) -> None:
        """Keep records without an id, which cannot be keyed, beside the table."""
        lost = without_id(rows).select(*RECORDS[table].names, *arrival, F.lit("no id").alias("reason"))
        self._keep_aside(table, lost, arrival)

    def set_aside_landed(self, table: str, lines: DataFrame, fetched_at: int, arrival: list[str]) -> None:
        """Keep landed lines (subreddit, value, problem, arrival) that no window can hold."""
        known = {
            "subreddit": F.col("subreddit"),
            "archive_json": F.col("value"),
            "fetched_at": F.lit(fetched_at),
        }
        fields = [
            known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORDS[table]
        ]
        self._keep_aside(table, lines.select(*fields, *arrival, F.col("problem").alias("reason")), arrival)

    def _keep_aside(self, table: str, rows: DataFrame, arrival: list[str]) -> None:
        """Append rows that are not kept yet; a repeated run finds its own rows there."""
        path = f"{self.root}/no_id/{table}"
        keys = [c for c in arrival if c != "line_place"] + ["archive_json", "reason"]
        if self._exists(path):
            kept = self.spark.read.option("mergeSchema", True).parquet(path)
            if set(keys) <= set(kept.columns):
                same = [rows[k].eqNullSafe(kept[k]) for k in keys]
                rows = rows.join(kept, reduce(and_, same), "left_anti")
        rows = write_table(rows, "aside")
        if not rows.isEmpty():
            rows.write.mode("append").parquet(path)

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows of a keyed table anew."""
        self.keyed(table).replace(rows)

    def change(self, table: str, rows: DataFrame) -> None:
        """Replace the rows of the keys in ``rows``; no others are read or written."""
        self.keyed(table).change(rows)

    def _read(self, path: str, layout: StructType) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(path)

    def _exists(self, path: str) -> bool:
        return self._files.exists(path)

    def posts_with_live_counts(self) -> DataFrame:
        """Posts with the latest refreshed counts, which are kept apart from the immutable rows."""
        refreshed = self.read("live_counts").withColumn("outcome", F.lit("refreshed"))
        return merge_live_counts(self.read("posts"), refreshed)
