"""Which ids does a table hold: an index in buckets of the id's hash, with Bloom filters.

``add`` writes the ids of an append into their buckets (folders) and one Bloom filter for each bucket
it touches. ``known`` first asks the filters: of a batch of new ids, almost all are in no bucket.
Only buckets with ids that may be there are read, and only their id column; the table itself is
not. A small batch hits few buckets, a large one reads each bucket once.

A filter is made of at most about ``SLICE`` ids, so a bucket has one per append, or several of a large
one: n ids make n * ``BITS`` bits. ``compact`` joins a bucket's files and filters. A batch of more than
``FILTERED`` ids is joined with the buckets right away, as it would read most of them anyway.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.scratch import write_table

from .files import Files

BUCKETS = 256
BITS = 12  # per id: with HASHES probes, about 3 in 1000 absent ids pass a filter
HASHES = 8
WORD = 64
SLICE = 1_000_000
FILTERED = 2_000_000

_FILTER = "bucket int, size bigint, bits binary"


def _places(ids: pa.Array, size: int) -> np.ndarray:
    """Bit numbers of every id: two halves of a 128-bit hash give all probes."""
    raw = b"".join(xxhash.xxh3_128_digest(i) for i in ids.cast(pa.binary()).to_pylist())
    one, two = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64).T
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (one + steps * (two | np.uint64(1))) % np.uint64(size)


def _filter(key: tuple, ids: pa.Table) -> pa.Table:
    """The Bloom filter of one bucket's ids."""
    column = ids["id"].combine_chunks()
    size = -(-max(len(column), 1) * BITS // WORD) * WORD
    bits = np.zeros(size, bool)
    bits[_places(column, size)] = True
    packed = [np.packbits(bits, bitorder="little").tobytes()]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([size]), pa.array(packed, pa.binary())],
                    names=["bucket", "size", "bits"])


def _maybe(key: tuple, ids: pa.Table, filters: pa.Table) -> pa.Table:
    """Ids of one bucket that any of its filters lets through."""
    column = ids["id"].combine_chunks()
    found = np.zeros(len(column), bool)
    for size, bits in zip(filters["size"].to_pylist(), filters["bits"]):
        packed = np.frombuffer(bits.as_buffer(), np.uint8)
        places = _places(column, size)
        held = packed[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1
        found |= held.all(axis=0)
    return ids.filter(pa.array(found))


def bucket_of(id: str = "id"):
    return F.pmod(F.xxhash64(id), F.lit(BUCKETS)).cast("int")


class IdIndex:
    """The ids of one table. ``folder`` holds ``ids``, ``filters`` and ``open``: the marks of appends
    that are not indexed yet."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._files = Files(spark)

    # Appends in progress. A mark left by a run that died says that ids may be missing.

    def begin(self) -> str:
        mark = uuid.uuid4().hex
        self._files.create(f"{self.folder}/open/{mark}", "")
        return mark

    def end(self, mark: str) -> None:
        self._files.delete(f"{self.folder}/open/{mark}")

    def is_whole(self) -> bool:
        """All ids of the table are indexed."""
        return self._files.exists(f"{self.folder}/ids") and not self._marks()

    def _marks(self) -> list[str]:
        return [n for n in self._files.names(f"{self.folder}/open") if n[0] not in "._"]

    # Ids

    def add(self, ids: DataFrame) -> None:
        rows = ids.select("id", bucket_of().alias("bucket"))
        self._write(rows, "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        slices = 1 + rows.count() // (BUCKETS * SLICE)
        placed = rows.repartition("bucket").sortWithinPartitions("bucket", "id")
        placed.write.mode(mode).partitionBy("bucket").parquet(f"{self.folder}/ids")
        piece = F.pmod(F.hash("id"), F.lit(slices)).alias("slice")
        filters = rows.groupBy("bucket", piece).applyInArrow(_filter, _FILTER)
        filters.write.mode(mode).partitionBy("bucket").parquet(f"{self.folder}/filters")

    def _read(self, what: str, layout: str) -> DataFrame:
        return self.spark.read.schema(layout).parquet(f"{self.folder}/{what}")

    def known(self, batch: DataFrame) -> DataFrame:
        """Distinct ids of ``batch`` that are in the table."""
        asked = batch.where(F.col("id").isNotNull()).select("id").distinct()
        asked = write_table(asked.select("id", bucket_of().alias("bucket")), "asked")
        if asked.count() > FILTERED:
            return asked.join(self._read("ids", "id string, bucket int"), ["bucket", "id"], "left_semi").select("id")
        filters = self._read("filters", "size bigint, bits binary, bucket int")
        filters = filters.where(F.col("bucket").isin(self._hit(asked)))
        maybe = asked.groupBy("bucket").cogroup(filters.groupBy("bucket"))
        maybe = write_table(maybe.applyInArrow(_maybe, "id string, bucket int"), "maybe")
        ids = self._read("ids", "id string, bucket int").where(F.col("bucket").isin(self._hit(maybe)))
        return maybe.join(ids, ["bucket", "id"], "left_semi").select("id")

    def _hit(self, rows: DataFrame) -> list[int]:
        """Buckets of ``rows``: no more than there are."""
        return sorted(r.bucket for r in rows.select("bucket").distinct().collect())

    def rebuild(self, ids: DataFrame) -> None:
        """Index ``ids``, all ids of the table, anew, and forget about appends that were not."""
        marks = [*self._marks(), self.begin()]
        for what in ("ids", "filters"):
            self._files.delete(f"{self.folder}/{what}")
        self._write(ids.where(F.col("id").isNotNull()).select("id", bucket_of().alias("bucket")), "overwrite")
        for mark in marks:
            self.end(mark)

    def compact(self) -> None:
        """One file and one filter per bucket."""
        self.rebuild(write_table(self._read("ids", "id string, bucket int").select("id"), "ids"))
