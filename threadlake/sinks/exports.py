"""Text exports below ``<path>/<name>/subreddit=<community>/``.

Rows are range partitioned by community and the order inside it: a community's rows sit in few
files, in order from file to file, and a huge community is spread over many writers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import json_quote
from threadlake.schemas import COMMENT_CSV, POST_CSV

CSV_COLUMNS = {"posts": POST_CSV, "comments": COMMENT_CSV}


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    keys = ["subreddit", *order]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def append_jsonl(fresh: DataFrame, path: str, kind: str, enabled: bool = True) -> None:
    """Append the raw records of fresh rows, one JSON object per line."""
    if not enabled:
        return
    rows = _ordered(fresh, "created_utc", "id").select("subreddit", F.col("archive_json").alias("value"))
    rows.write.mode("append").partitionBy("subreddit").text(f"{path}/{kind}.jsonl")


def append_trees(trees: DataFrame, path: str, enabled: bool = True) -> None:
    """Append ``{"link_id": ..., "tree": ...}`` lines of landed trees."""
    if not enabled:
        return
    line = F.concat(
        F.lit('{"link_id": '), json_quote("link_id"), F.lit(', "tree": '), "tree_json", F.lit("}")
    )
    rows = _ordered(trees, "link_id").select("subreddit", line.alias("value"))
    rows.write.mode("append").partitionBy("subreddit").text(f"{path}/comment_trees.jsonl")


def write_threads(fragments: DataFrame, path: str) -> None:
    """Replace the thread lines of the communities in ``fragments`` (from ``thread_json``).

    One line of JSON per post, whatever its size: a post's fragments are sorted in the task that
    writes them and streamed to the file one after another, with a blank between them; the last
    one brings the line feed. So every line but a file's first begins with a blank.
    """
    rows = fragments.repartitionByRange("subreddit", "link_id")
    rows = rows.sortWithinPartitions("subreddit", "link_id", "pos")
    (
        rows.select("subreddit", F.col("text").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", " ")
        .partitionBy("subreddit")
        .text(f"{path}/threads.jsonl")
    )


_CSV = {
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _with_headers(header: str) -> Callable:
    """A header in front of each community's lines in a task, which are one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = object()
        for batch in batches:
            folders, values = [], []
            for folder, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if folder != last:
                    folders.append(folder)
                    values.append(header)
                    last = folder
                folders.append(folder)
                values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(folders, pa.string()), pa.array(values, pa.string())], names=["community", "value"]
            )

    return run


def write_csv(table: DataFrame, path: str, kind: str) -> None:
    """Replace the flat export of a kind: a header in every file, lines that end in CRLF, quotes
    doubled, NULL as empty, and values as they are.

    Lines are written as text: Spark's CSV writer would make every line break inside a value the one
    that ends lines.
    """
    names = CSV_COLUMNS[kind]
    rows = _ordered(table, "created_utc", "id").select(
        F.col("subreddit").alias("community"), F.to_csv(F.struct(*names), _CSV).alias("value")
    )
    (
        rows.mapInArrow(_with_headers(",".join(names)), "community string, value string")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("community")
        .option("lineSep", "\r\n")
        .text(f"{path}/{kind}.csv")
    )
