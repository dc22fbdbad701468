import math
import random

import numpy as np
from pyspark.sql import functions as F

from threadlake.llm import threshold_search as ts
from threadlake.scratch import Scratch

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k, is_query):
    usable = [
        (n, i, [math.floor(256 * x) for x in np.float32(v).astype(float)])
        for n, (i, v, _) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in usable:
        if i is not None and is_query(i):
            others = [
                (-sum(a * b for a, b in zip(q, v)), j if j is not None else math.inf)
                for m, j, v in usable
                if m != n and len(v) == len(q)
            ]
            for rank, (s, j) in enumerate(sorted(others)[:k], 1):
                out.append((i, rank, None if j == math.inf else j, -s))
    return sorted(map(repr, out))


def found(spark, rows, k=5, **options):
    vectors = spark.createDataFrame(rows, SCHEMA)
    out = ts.search(vectors, F.col("vec_id") % 5 == 0, Scratch(spark, "t"), k, **options)
    return sorted(repr(tuple(r)) for r in out.collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], "x") for i in range(300)]
    rows += [(300 + i, [0.1, -0.2, 0.3, 0.0, 0.1, -0.1], "x") for i in range(60)]  # copies: ties
    rows += [
        (400, None, "x"), (405, [], "x"), (410, [float("nan")] * 6, "x"), (415, [None] * 6, "x"),
        (420, [float("inf")] + [0.0] * 5, "x"), (425, [0.0] * 6, "x"), (430, [0.5, 0.5], "x"),
        (435, [0.4, 0.1], "x"), (None, [0.3] * 6, "x"), (5, [0.2] * 6, "x"), (5, [0.2] * 6, "x"),
    ]
    want = brute(rows, 5, lambda i: i % 5 == 0)
    assert found(spark, rows) == want
    assert found(spark, rows, candidates_per_block=50, queries_per_block=7) == want
    assert found(spark, rows[:3], k=5) == brute(rows[:3], 5, lambda i: i % 5 == 0)
    assert found(spark, []) == []


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    vectors = np.abs(rng.normal(0, 40, (4000, 3))).astype(np.float32).round()
    vectors[17] = 400  # far ahead of the rest
    lists = ts.SortedLists(vectors, np.arange(4000))
    looked = []

    class Counting(np.ndarray):
        def __getitem__(self, rows):
            looked.append(np.size(rows))
            return np.asarray(self)[rows]

    lists.vectors = vectors.view(Counting)
    best, scores = lists.search(np.array([3, 2, 1], np.float32), 1)
    assert best.tolist() == [17] and scores[0] == 2400
    assert sum(looked) < 400


def test_wide_numbers():
    small, large = ts._exact(np.array([[3, 4]]), np.array([[5, 6]])), 2**30
    assert small[0].dtype == np.float32
    whole = ts._exact(np.array([[large, large]]), np.array([[large, large - 1]]))
    assert int((whole[0] @ whole[1].T)[0, 0]) == large * large + large * (large - 1)
