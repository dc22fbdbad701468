"""Helpers shared by the operators: Arrow functions that pass every other column through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.bagminhash import slices

PART_BYTES = 4 << 20  # of text given to a function, and sent back to the JVM, at a time


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The whole text; a null one is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _parts(batch: pa.RecordBatch, inputs: list[int]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about PART_BYTES of text in the inputs; a longer text comes alone."""
    lengths = np.zeros(batch.num_rows, np.int64)
    for column in (batch.column(i) for i in inputs):
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            lengths += pc.binary_length(column).fill_null(0).to_numpy()
    for s in slices(lengths, PART_BYTES):
        yield batch.slice(s.start, s.stop - s.start)


def add_columns(
    df: DataFrame,
    function: Callable[..., list[pa.Array]],
    inputs: list[str],
    outputs: str,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Append the columns that ``function`` makes of the Arrow arrays of ``inputs``, part by part.

    Arrow batches are cut to parts of bounded size, so that what a task holds beside its batch does
    not depend on how many rows Spark puts in one; no row's result may depend on its neighbours.
    All other columns but ``without`` pass through untouched. A column that already has the name
    of an output (whatever its case) is replaced; it may still be read as an input.
    """
    added = T.StructType.fromDDL(outputs)
    gone = {name.lower() for name in (*added.fieldNames(), *without)}
    kept = [c for c in df.columns if c.lower() not in gone]
    extra = {c: f"_in_{i}" for i, c in enumerate(inputs) if c not in kept}
    sent = df.select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in extra.items()]
    )
    schema = T.StructType(sent.schema.fields[: len(kept)] + added.fields)
    names, n = schema.fieldNames(), len(kept)
    places = [sent.columns.index(extra.get(c, c)) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch, places)):
            new = function(*[part.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=names)

    return sent.mapInArrow(run, schema)
