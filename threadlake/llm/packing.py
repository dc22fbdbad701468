"""Best-fit packing of documents into sequences of fixed length, with conflicts.

No sequence (bin) holds two documents of one source, or two of one duplicate cluster. A document
longer than a bin is first cut into full bins of its own and a rest; nothing is dropped or cut
otherwise, except that a document of size 0 takes a place of size 0 in a bin like any other.

Documents are dealt at random (by hash) over shards whose number grows with the table, so that each
shard holds about ``shard_documents`` of them whatever their source; a shard is packed in one task
step, largest first. Bins are ordered by free space, and each carries bitmaps of its sources and
clusters; the search starts at the first bin that is large enough and goes on to the next larger
one until it finds a compatible one, which is the tightest. A hot source fills a third of every
shard, not one task.

A null source or cluster conflicts with nothing. Null sizes count as 0. Ties are broken by the
order of (size, id, row), so equal input gives equal bins; repeated rows are numbered and packed as
separate documents, each with bins and a shard of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.frames import text_of

SHARD_DOCUMENTS = 4096
CAPACITY = 2048
_BLANKS = " \t\n\x0b\x0c\r"


def cluster_of(text: str | Column) -> Column:
    """Duplicate cluster: texts equal but for case, blanks and marks; null for one without letters."""
    letters = F.regexp_replace(F.lower(text_of(text)), r"[^\p{L}\p{N}]+", "")
    return F.when(letters != "", F.md5(letters.cast("binary")))


def with_sizes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``pack`` reads: id, source, size in words, and duplicate cluster.

    Words are runs of other characters than the six ASCII blanks; a text of blanks only has none.
    """
    trimmed = F.btrim(text_of(text), F.lit(_BLANKS))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    return docs.select(
        F.col(id), "source", words.cast("bigint").alias("size"), cluster_of(text).alias("cluster")
    )


def _bits(values: list) -> list[int]:
    """A bit for each value that occurs twice or more; others conflict with nothing."""
    places: dict = {}
    again: set = set()
    for v in values:
        again.add(v) if v in places else places.setdefault(v, None)
    numbers = {v: 1 << i for i, v in enumerate(x for x in places if x in again and x is not None)}
    return [numbers.get(v, 0) for v in values]


def best_fit(
    sizes: list[int], sources: list, clusters: list, capacity: int
) -> tuple[list[int], list[int]]:
    """Bin number and offset of each document, taken in the given order; sizes fit in a bin."""
    source_bits, cluster_bits = _bits(sources), _bits(clusters)
    order: list[tuple[int, int]] = []  # (free space, bin), ascending
    masks: list[tuple[int, int]] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, source_bits, cluster_bits):
        at = bisect_left(order, (size, -1))
        while at < len(order):
            has_source, has_cluster = masks[order[at][1]]
            if not (has_source & source or has_cluster & cluster):
                break
            at += 1
        if at < len(order):
            free, number = order.pop(at)
            masks[number] = (masks[number][0] | source, masks[number][1] | cluster)
        else:
            free, number = capacity, len(masks)
            masks.append((source, cluster))
        bins.append(number)
        offsets.append(capacity - free)
        insort(order, (free - size, number))
    return bins, offsets


def _pack_shards(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _whole_shards(batches):
            order = pc.sort_indices(
                shard,
                [("_rest", "descending"), ("_size", "descending"), ("_order", "ascending")],
            )
            shard = shard.take(order)
            columns = (shard.column(c).to_pylist() for c in ("_rest", "_source", "_cluster"))
            bins, offsets = best_fit(*columns, capacity)
            shard = shard.append_column("_bin", pa.array(bins, pa.int64()))
            shard = shard.append_column("_offset", pa.array(offsets, pa.int64()))
            yield from shard.to_batches()

    return run


def _whole_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Shards lie one after another in a task; Arrow batches may cut them anywhere."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        shards = batch.column("_shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(shards)]):
            if stop > start:
                if held and shards[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, stop - start))
                last = shards[start]
    if held:
        yield pa.Table.from_batches(held)


def _numbered(narrow: DataFrame) -> DataFrame:
    """Every row, with its number among equal ones (_copy).

    Equal rows are counted and dealt out again in two steps, so none of them meet in a sort or a
    large array.
    """
    counted = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("_n"))
    blocks = counted.select(
        "*", F.explode(F.expr(f"sequence(0L, (_n - 1) div {SHARD_DOCUMENTS})")).alias("_block")
    )
    first = f"_block * {SHARD_DOCUMENTS}"
    last = f"least(_n, {first} + {SHARD_DOCUMENTS}) - 1"
    copies = F.explode(F.expr(f"sequence({first}, {last})")).alias("_copy")
    return blocks.select(*narrow.columns, copies)


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    size: str = "size",
    source: str = "source",
    cluster: str = "cluster",
    capacity: int = CAPACITY,
    shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """Pieces of documents with their places: id, piece, start, length, bin_id, bin_offset.

    ``start`` is the place of the piece in its document. ``bin_id`` reads shard-number for shared
    bins, and f-shard-row-piece for the full bins of long documents.
    """
    narrow = docs.select(
        F.col(id).alias("_id"),
        F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size"),
        F.col(source).cast("string").alias("_source"),
        F.col(cluster).cast("string").alias("_cluster"),
    )
    shards = max(1, -(-narrow.count() // shard_documents))
    # The hash passes over nulls, so it also takes which values are null.
    values = ("_id", "_size", "_source", "_cluster", "_copy")
    key = F.xxhash64(*values, *[F.col(c).isNull() for c in ("_id", "_source", "_cluster")])
    dealt = _numbered(narrow).select(
        "*",
        (F.col("_size") % capacity).alias("_rest"),
        F.pmod(key, F.lit(shards)).alias("_shard"),
        key.alias("_order"),
    ).withColumn(  # a document of exactly full bins has no rest to share
        "_rest",
        F.when((F.col("_rest") == 0) & (F.col("_size") > 0), None).otherwise(F.col("_rest")),
    )
    full = (
        dealt.where(F.col("_size") >= capacity)
        .select(
            "_id",
            "_shard",
            "_order",
            F.explode(F.sequence(F.lit(0), F.expr(f"int(_size div {capacity}) - 1"))).alias("_p"),
        )
        .select(
            F.col("_id").alias(id),
            F.col("_p").cast("bigint").alias("piece"),
            (F.col("_p").cast("bigint") * capacity).alias("start"),
            F.lit(capacity).cast("bigint").alias("length"),
            F.concat_ws("-", F.lit("f"), "_shard", F.hex("_order"), "_p").alias("bin_id"),
            F.lit(0).cast("bigint").alias("bin_offset"),
        )
    )
    rests = dealt.where(F.col("_rest").isNotNull())
    placed = rests.repartition("_shard").sortWithinPartitions("_shard")
    schema = T.StructType(
        [*placed.schema, T.StructField("_bin", T.LongType()), T.StructField("_offset", T.LongType())]
    )
    packed = placed.mapInArrow(_pack_shards(capacity), schema).select(
        F.col("_id").alias(id),
        F.expr(f"_size div {capacity}").alias("piece"),
        (F.col("_size") - F.col("_rest")).alias("start"),
        F.col("_rest").alias("length"),
        F.concat_ws("-", "_shard", "_bin").alias("bin_id"),
        F.col("_offset").alias("bin_offset"),
    )
    return full.unionByName(packed)
