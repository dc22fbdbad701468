"""Ledger of a stream's batches: which are done, what they did, whom they follow.

A batch is known by its stream (the id in its checkpoint) and number. Its entry is created at once,
when all that it writes is written, so a batch counts once however often it is replayed, and two
drivers cannot both finish it. A lost checkpoint begins a new stream with batches of its own.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from .files import Files


class Commits:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._files = Files(spark)

    def stream_of(self, checkpoint: str) -> str:
        """Id of the stream that writes this checkpoint; it lasts as long as the checkpoint."""
        return json.loads(self._files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"]

    def _entry(self, stream: str, batch: int) -> str:
        return f"{self.folder}/{stream}/done/b{batch:012d}.json"

    def is_done(self, stream: str, batch: int) -> bool:
        return self._files.exists(self._entry(stream, batch))

    def finish(self, stream: str, batch: int, counts: dict[str, int], followed: DataFrame) -> None:
        """Enter a batch: what it counted, and the communities (subreddit) it has seen."""
        followed.select("subreddit").write.mode("overwrite").parquet(
            f"{self.folder}/{stream}/followed/batch={batch}"
        )
        self._files.create(self._entry(stream, batch), json.dumps(counts))

    def batches(self, stream: str) -> list[int]:
        names = self._files.names(f"{self.folder}/{stream}/done")
        return [int(n[1:13]) for n in names if re.fullmatch(r"b\d{12}\.json", n)]

    def counts(self, stream: str) -> dict[int, dict[str, int]]:
        return {b: json.loads(self._files.read(self._entry(stream, b))) for b in self.batches(stream)}

    def followed(self, stream: str) -> DataFrame:
        """Communities (lower case) that any finished batch has seen."""
        layout, done = "subreddit string, batch bigint", self.batches(stream)
        if not done:
            return self.spark.createDataFrame([], "subreddit string")
        rows = self.spark.read.schema(layout).parquet(f"{self.folder}/{stream}/followed")
        return rows.where(rows["batch"].isin(done)).select("subreddit").distinct()
