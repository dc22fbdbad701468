"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are quantised to integers and dealt at random over blocks. A cell of work is one block of
queries against one block of candidates; Spark shuffles both to it, and the k best of each cell are
merged per query. A block's candidates are sorted once by every dimension. A query reads these
lists side by side from its good end (largest values for a positive component, smallest for a
negative one), looks up the whole vector of every row it meets for the first time, and keeps the k
best. The sum of the query's components times the values it has reached bounds every row it has not
met; once the k-th best is above that bound, the search stops. A bound that only equals the k-th
best does not stop it, as a row with the same score and a smaller id may follow.

Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of
different lengths are never compared. Ties go to the smaller id, then to the row met first (a null
id comes last). A row is never its own result; another row with the same id is, and repeated query
rows each get results of their own. Scores are exact while components stay below 2 ** 31 in size
and a score below 2 ** 63; larger ones raise an error. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.scratch import Scratch

CANDIDATES_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 256
_NO_ID = np.iinfo(np.int64).max


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, or null for a vector that takes no part."""
    values = F.col(vector).cast("array<double>")
    usable = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    scaled = F.transform(values, lambda x: F.floor(x * scale).cast("bigint"))
    return F.when(usable & (F.size(values) > 0), scaled)


class SortedLists:
    """One block of candidates with its rows in order of every dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.vectors, self.ids = vectors, ids
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def search(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best for one query; ``own`` is the query's row here, or -1."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        best, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        depth, step = 0, max(32, n // 64)
        while depth < n:
            stop = min(depth + step, n)
            met = np.zeros(n, bool)
            if len(up) or len(down):
                met[self.order[up, n - stop : n - depth].ravel()] = True
                met[self.order[down, depth:stop].ravel()] = True
                met &= ~seen
            else:  # a query of zeros: every row scores 0
                met[:], stop = True, n
            seen |= met
            if own >= 0:
                met[own] = False
            fresh = np.flatnonzero(met)
            best = np.concatenate([best, fresh])
            scores = np.concatenate([scores, self.vectors[fresh] @ query])
            if len(best) > k:  # all that are at least as good as the k-th, then ties by id
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                good = scores >= least
                best, scores = best[good], scores[good]
                first = np.lexsort((best, self.ids[best], -scores))[:k]
                best, scores = best[first], scores[first]
            if len(best) == k:
                bound = (
                    self.values[up, n - stop] @ query[up] + self.values[down, stop - 1] @ query[down]
                )
                if scores.min() > bound:
                    break
            depth, step = stop, step * 2
        order = np.lexsort((best, self.ids[best], -scores))
        return best[order], scores[order]


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy() for c in vectors.chunks])
    return flat.reshape(-1, size)


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The same numbers in the narrowest type whose inner products are exact."""
    most = [float(np.abs(p).max(initial=0)) for p in parts]
    product = most[0] * most[1] * parts[0].shape[1]
    if max(most) >= 2**31 or product >= 2**63:
        raise ValueError(f"components up to {max(most):.3g} are too large for exact scores")
    kind = np.float32 if product < 2**24 else np.float64 if product < 2**53 else np.int64
    return [np.ascontiguousarray(p, kind) for p in parts]


_FOUND = pa.schema(
    [("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
     ("row", pa.int64()), ("score", pa.int64())]
)
_FOUND_DDL = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"


def _cell(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        size = len(queries.column("vector")[0])
        wanted, vectors = _exact(
            _matrix(queries.column("vector"), size), _matrix(candidates.column("vector"), size)
        )
        ids = candidates.column("vec_id").fill_null(_NO_ID).to_numpy()
        rows = candidates.column("row").to_numpy()
        place = {row: i for i, row in enumerate(rows.tolist())}
        lists = SortedLists(vectors, ids)
        parts = []
        query_rows = queries.column("row").to_pylist()
        for i, row in enumerate(query_rows):
            best, scores = lists.search(wanted[i], k, place.get(row, -1))
            parts.append((np.full(len(best), i), best, scores.astype(np.int64)))
        which, best, scores = (np.concatenate(x) for x in zip(*parts))
        columns = [
            queries.column("row").take(pa.array(which)),
            queries.column("vec_id").take(pa.array(which)),
            candidates.column("vec_id").take(pa.array(best)),
            candidates.column("row").take(pa.array(best)),
            pa.array(scores),
        ]
        return pa.Table.from_arrays(columns, schema=_FOUND)

    return run


def search(
    vectors: DataFrame,
    is_query: Column,
    scratch: Scratch,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row with ``is_query``."""
    numbered = scratch.write(
        vectors.select(
            F.col(id).cast("bigint").alias("vec_id"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
            quantised(vector, scale).alias("vector"),
        )
        .where(F.col("vector").isNotNull())
        .withColumn("size", F.size("vector"))
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    queries = numbered.where("is_query")
    n, n_queries = numbered.count(), queries.count()
    blocks = max(1, -(-n // candidates_per_block))
    query_blocks = max(1, -(-n_queries // queries_per_block))
    deal = F.xxhash64("row")
    left = numbered.select(
        "vec_id",
        "row",
        "vector",
        "size",
        F.pmod(deal, F.lit(blocks)).cast("bigint").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    right = queries.select(
        "vec_id",
        "row",
        "vector",
        "size",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
        F.pmod(deal, F.lit(query_blocks)).cast("int").alias("query_block"),
    )
    cell = ["size", "block", "query_block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), _FOUND_DDL)
    best = Window.partitionBy("query_row").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same in SQL over a table ``embeddings`` whose ids are unique.
SQL = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
