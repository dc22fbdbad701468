"""Reply trees of posts that fit a task: whole posts side by side in arrays.

Rows come sorted by post, time and id; a batch is cut behind its last whole post, so no more than a
batch and one post are held at once. Inside a batch all posts are resolved together: parents by a
sorted search, depth and root by pointer jumping, sizes of subtrees from the deepest level up, and
places from the roots down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

POST = ["link_id", "subreddit"]
PLACED = (
    "subreddit string, link_id string, id string, parent string, root_id string, depth int, pos bigint, "
    "_size bigint, _before int, _after int"
)


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """True where another post begins."""
    begins = np.ones(rows.num_rows, bool)
    codes = [_codes(rows[c]) for c in POST]
    begins[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return begins


def _parents(rows: pa.RecordBatch, post: np.ndarray) -> np.ndarray:
    """Row of each row's parent, -1 for roots. A post without a community has no replies."""
    coded = rows["id"].dictionary_encode()
    wanted = pc.index_in(rows["named"], value_set=coded.dictionary)
    known = pc.and_(wanted.is_valid(), rows["subreddit"].is_valid()).to_numpy(zero_copy_only=False)
    width = len(coded.dictionary) + 1
    own, key = (
        post * width + pc.fill_null(c, width - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in (coded.indices, wanted)
    )
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], key), len(own) - 1)
    found = known & (own[order][at] == key)
    return np.where(found, order[at], -1)


def _excluding_own(sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sum of the earlier rows' ``sizes`` in each row's group."""
    order = np.argsort(group, kind="stable")
    sums = np.cumsum(sizes[order]) - sizes[order]
    first = np.append(True, group[order][1:] != group[order][:-1])
    sums -= sums[np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.empty(len(sizes), np.int64)
    out[order] = sums
    return out


def place_rows(rows: pa.Table) -> pa.RecordBatch:
    """Whole posts, sorted by post, time and id: their rows with parent, root, depth, place, the number
    of placed comments and the depths of the neighbours in reading order."""
    rows = rows.combine_chunks().to_batches()[0]
    n = rows.num_rows
    post = np.cumsum(_starts(rows)) - 1
    up = _parents(rows, post)
    top, depth = np.where(up < 0, np.arange(n), up), (up >= 0).astype(np.int64)
    for _ in range(int(np.bincount(post).max()).bit_length()):
        depth, top = depth + depth[top], top[top]
    some = np.flatnonzero(up[top] < 0)  # the others are led round in a ring
    by_depth = some[np.argsort(depth[some], kind="stable")]
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    size = np.ones(n, np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, up[level], size[level])
    ahead = np.zeros(n, np.int64)
    if len(some):
        ahead[some] = _excluding_own(size[some], np.where(up[some] < 0, post[some], up[some] + n))
    pos = ahead + 1
    for level in levels[1:]:
        pos[level] += pos[up[level]]

    whole = np.bincount(post[some], minlength=int(post[-1]) + 1)[post]
    walk = some[np.lexsort((pos[some], post[some]))]
    same = post[walk][1:] == post[walk][:-1]
    before, after = np.full(n, -1), np.full(n, -1)
    before[walk[1:][same]] = depth[walk[:-1][same]]
    after[walk[:-1][same]] = depth[walk[1:][same]]
    loose = np.ones(n, bool)
    loose[some] = False
    ids = rows["id"]
    return pa.RecordBatch.from_arrays(
        [
            rows["subreddit"],
            rows["link_id"],
            ids,
            ids.take(pa.array(up, mask=up < 0)),
            ids.take(pa.array(top, mask=loose)),
            pa.array(depth.astype(np.int32), mask=loose),
            pa.array(pos, mask=loose),
            pa.array(whole, mask=loose),
            pa.array(before.astype(np.int32), mask=before < 0),
            pa.array(after.astype(np.int32), mask=after < 0),
        ],
        names=[c.split()[0] for c in PLACED.split(", ")],
    )


def _whole_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        last = int(np.flatnonzero(_starts(rows.to_batches()[0]))[-1])
        if last:
            yield place_rows(rows.slice(0, last))
            held = rows.slice(last).to_batches()
    if held:
        yield place_rows(pa.Table.from_batches(held))


def placed(comments: DataFrame, named: Column) -> DataFrame:
    """Comments (POST, id, created_utc) of small posts with their places; those in no tree have none.

    ``named`` is the id a reply names as its parent, NULL for roots.
    """
    rows = comments.select(*POST, "id", "created_utc", named.alias("named"))
    together = rows.repartition(*POST).sortWithinPartitions(*POST, "created_utc", "id")
    return together.mapInArrow(_whole_posts, PLACED)
