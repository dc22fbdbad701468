"""Written intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts the lineage (a lost executor recomputes nothing upstream of it), freezes
non-deterministic values, and gives Catalyst the true size of a side when it picks a join. The shuffle files that writing it took are deleted at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _local_folder()
    return base.rstrip("/")


@cache
def _local_folder() -> str:
    """Stands in for the setting in local sessions, such as tests."""
    return tempfile.mkdtemp(prefix="threadlake-")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed here go when it ends, not when the driver happens to collect
    its garbage. Only for plans that are not executed again."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


class Scratch:
    """Tables of one job in a folder of their own, dropped once nothing reads them any more.

    Whatever is not dropped goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self._folder = f"{shared_folder(spark)}/threadlake/{label}-{uuid.uuid4().hex}"
        path = self._path(self._folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(path)
        self._count = 0

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def folder(self, name: str) -> str:
        """A path not used before, for writers other than Parquet."""
        self._count += 1
        return f"{self._folder}/{name}-{self._count}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back."""
        path = self.folder(name)
        with _shuffles_dropped(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def write_counted(self, df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
        """``write``, and the number of rows meeting a condition, counted by the same job."""
        seen = Observation()
        table = self.write(df.observe(seen, F.count_if(condition).alias("n")), name)
        return table, seen.get.get("n", 0)  # an empty result observes nothing

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` gave; no later job may read them."""
        for table in tables:
            self._files.delete(self._path(table._scratch_path), True)

    def drop_all(self) -> None:
        self._files.delete(self._path(self._folder), True)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back; the files go when the application ends."""
    return Scratch(df.sparkSession, label).write(df, "table")
