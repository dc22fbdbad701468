"""Landed files converted once, to an archive that can be read by month.

Which files are converted is kept by the checkpoint of a file stream inside the store, and which of
its batches are complete by the ledger (``Commits``). Each line is parsed once, gets its place in
the order of arrival, and goes to the folder of its month; lines that no window can hold are set
aside then and there. A later run reads the months it needs, and no landed text.

Folders: ``landed/<kind>/created_month=/batch=``. A replayed batch replaces its own folders; readers
see only finished batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType, TimestampType

from threadlake.functions import month_of_epoch
from threadlake.scratch import Scratch

from .archive import ARRIVAL, landed_records, placed_lines, with_line_place
from .store import Store

LAYOUT = (
    StructType()
    .add("kind", StringType())
    .add("subreddit", StringType())
    .add("created_utc", LongType())
    .add("id", StringType())
    .add("value", StringType())
    .add("file_time", TimestampType())
    .add("file_path", StringType())
    .add("block_start", LongType())
    .add("line_place", LongType())
    .add("community", StringType())
    .add("created_month", IntegerType())
    .add("batch", LongType())
)
KINDS = ("posts", "comments")


class Landing:
    """The converted archive of a store."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.folder = f"{store.root}/landed"

    def _checkpoint(self, kind: str) -> str:
        return f"{self.folder}/{kind}-checkpoint"

    def convert(self, kind: str, landed: str, fetched_at: int, **source_options) -> None:
        """Convert the files below ``landed`` that are new since the last time."""
        spark, commits = self.store.spark, self.store.commits

        def load(batch: DataFrame, number: int) -> None:
            stream = commits.stream_of(self._checkpoint(kind))
            if commits.is_done(stream, number):
                return
            scratch = Scratch(spark, "landing")
            lines = scratch.write(placed_lines(with_line_place(batch), kind), "lines")
            self._write(lines.where(F.col("problem").isNull()), kind, number)
            odd = lines.where(F.col("problem").isNotNull())
            self.store.set_aside_landed(kind, odd, fetched_at, ARRIVAL)
            seen = lines.select(F.lower("subreddit").alias("subreddit")).distinct()
            commits.finish(stream, number, {"lines": lines.count(), "aside": odd.count()}, seen)
            scratch.drop_all()

        query = (
            landed_records(spark, landed, stream=True, **source_options)
            .writeStream.foreachBatch(load)
            .option("checkpointLocation", self._checkpoint(kind))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _write(self, lines: DataFrame, kind: str, number: int) -> None:
        order = ["created_month", "community", "created_utc", "id"]
        rows = lines.drop("problem").withColumns(
            {
                "community": F.lower("subreddit"),
                "created_month": month_of_epoch("created_utc"),
                "batch": F.lit(number).cast("bigint"),
            }
        )
        (
            rows.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("created_month", "batch")
            .parquet(f"{self.folder}/{kind}")
        )

    def archive(self) -> DataFrame:
        """All converted lines, as ``run_backfill`` takes them; ``ARRIVAL`` orders copies."""
        parts = []
        for kind in KINDS:
            names = self.store.commits
            done = []
            if self.store._exists(f"{self._checkpoint(kind)}/metadata"):
                done = names.batches(names.stream_of(self._checkpoint(kind)))
            if done and self.store._exists(f"{self.folder}/{kind}"):
                rows = self.store.spark.read.schema(LAYOUT).parquet(f"{self.folder}/{kind}")
                parts.append(rows.where(F.col("batch").isin(done) & (F.col("kind") == kind)))
        empty = self.store.spark.createDataFrame([], LAYOUT)
        return (reduce(DataFrame.unionByName, parts) if parts else empty).drop("batch")
