"""Tables that change by key: a base, the changes since, and numbered manifests that list both.

A change writes the rows of the keys it touches and nothing else. It counts from the moment its
manifest has been created, under the number after the one it was made from. Two writers cannot
create the same number: the second one reads the first one's manifest and tries the next, so
neither change is lost. Readers merge when they read (``latest_by_key``): the base is joined with the
keys of the changes, which are few, and is neither sorted nor rewritten. ``compact`` makes a new base
of base and changes; ``expire`` removes manifests that are no longer read, and parts only these name.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Files

MOST_CHANGES = 16  # a change beyond these compacts the table first
KEPT = 3  # manifests left for those who still read them

Parts = list[dict]


def latest_by_key(base: DataFrame | None, changes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the last part that has their key. A part may hold several rows of a key: they are
    replaced together."""
    parts = changes if base is None else [base, *changes]
    if len(parts) == 1:
        return parts[0]
    numbered = [c.withColumn("_part", F.lit(i)) for i, c in enumerate(changes)]
    changed = reduce(DataFrame.unionByName, numbered)
    if len(changes) > 1:
        last = changed.groupBy(*keys).agg(F.max("_part").alias("_part"))
        changed = changed.join(last, [*keys, "_part"], "left_semi")
    changed = changed.drop("_part")
    if base is None:
        return changed
    touched = reduce(DataFrame.unionByName, [c.select(*keys) for c in changes]).distinct()
    return base.join(touched, keys, "left_anti").unionByName(changed)


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, layout: StructType, keys: list[str]) -> None:
        self.spark, self.folder, self.layout, self.keys = spark, folder, layout, keys
        self._files = Files(spark)

    # Manifests

    def versions(self) -> list[int]:
        names = self._files.names(f"{self.folder}/manifest")
        return [int(n[1:9]) for n in names if re.fullmatch(r"v\d{8}\.json", n)]

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifest/v{version:08d}.json"

    def parts(self, version: int | None = None) -> Parts:
        """What a version (by default the latest) is made of: the base, then the changes in order."""
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(self._files.read(self._manifest(version)))["parts"] if version else []

    def _commit(self, change: Callable[[Parts], Parts]) -> None:
        while True:
            version = max(self.versions(), default=0)
            parts = change(self.parts(version))
            if self._files.create(self._manifest(version + 1), json.dumps({"parts": parts})):
                return

    # Rows

    def _part(self, part: dict) -> DataFrame:
        return self.spark.read.schema(self.layout).parquet(f"{self.folder}/data/{part['name']}")

    def read(self) -> DataFrame:
        return self._merged(self.parts())

    def read_all(self) -> DataFrame:
        """Rows of all parts, replaced ones too, for tables whose rows are folded when read."""
        rows = [self._part(p) for p in self.parts()]
        return reduce(DataFrame.unionByName, rows, self.spark.createDataFrame([], self.layout))

    def _merged(self, parts: Parts) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.layout)
        base = [self._part(p) for p in parts if p["base"]]
        changes = [self._part(p) for p in parts if not p["base"]]
        return latest_by_key(base[0] if base else None, changes, self.keys)

    def _write(self, rows: DataFrame, base: bool) -> dict:
        part = {"name": uuid.uuid4().hex, "base": base}
        rows.select(*self.layout.names).write.parquet(f"{self.folder}/data/{part['name']}")
        return part

    def replace(self, rows: DataFrame) -> None:
        """All rows anew, whatever the table holds."""
        part = self._write(rows, base=True)
        self._commit(lambda _: [part])

    def change(self, rows: DataFrame) -> None:
        """Replace the rows of the keys in ``rows``, which are all a key shall have."""
        if len(self.parts()) > MOST_CHANGES:
            self.compact()
            self.expire()
        part = self._write(rows, base=False)
        self._commit(lambda parts: [*parts, part])

    def compact(self) -> None:
        """One base of what the table holds; changes made meanwhile stay behind it."""
        old = self.parts()
        if len(old) < 2:
            return
        part, names = self._write(self._merged(old), base=True), {p["name"] for p in old}

        def swapped(parts: Parts) -> Parts:
            if not names <= {p["name"] for p in parts}:  # replaced or compacted by another run
                return parts
            return [part, *[p for p in parts if p["name"] not in names]]

        self._commit(swapped)

    def expire(self, keep: int = KEPT) -> None:
        """Remove all but the last ``keep`` versions, and the parts that only these hold."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        needed = {p["name"] for v in kept for p in self.parts(v)}
        for part in {p["name"] for v in old for p in self.parts(v)} - needed:
            self._files.delete(f"{self.folder}/data/{part}")
        for version in old:
            self._files.delete(self._manifest(version))
