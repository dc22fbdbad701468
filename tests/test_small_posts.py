import pyarrow as pa
import pytest

from test_threads import brute_force, random_rows
from threadlake.operators import small_posts
from threadlake.operators.threads import build_forest


def flat(nodes, depth=0, root=None):
    for i, replies in nodes:
        yield i, depth, root or i
        yield from flat(replies, depth + 1, root or i)


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posts_cut_by_batches(seed, size):
    rows = random_rows(seed)
    ordered = sorted(rows, key=lambda r: (r[3], r[2], r[0]))
    table = pa.table({
        "link_id": [r[3] for r in ordered],
        "subreddit": ["s"] * len(rows),
        "id": [r[0] for r in ordered],
        "created_utc": [r[2] for r in ordered],
        "named": [r[1][3:] if r[1].startswith("t1_") else None for r in ordered],
    })
    found = [r for b in small_posts._whole_posts(iter(table.to_batches(size))) for r in b.to_pylist()]
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in rows)
    for (_, link), tree in brute_force(rows).items():
        mine = sorted((r for r in found if r["link_id"] == link and r["pos"]), key=lambda r: r["pos"])
        want = list(flat(tree))
        assert [(r["id"], r["depth"], r["root_id"]) for r in mine] == want
        assert [r["pos"] for r in mine] == list(range(1, len(want) + 1)) and {r["_size"] for r in mine} <= {len(want)}
        depths = [d for _, d, _ in want]
        assert [r["_before"] for r in mine] == [None, *depths[:-1]][: len(want)]
        assert [r["_after"] for r in mine] == [*depths[1:], None][: len(want)]


def test_small_posts_are_not_walked(spark):
    rows = [("s", f"t3_{i}", f"{i}{c}", p, 1, "{}") for i in range(3) for c, p in (("a", None), ("b", f"t1_{i}a"))]
    df = spark.createDataFrame(rows, "subreddit string, link_id string, id string, parent_id string, created_utc bigint, archive_json string")
    forest = build_forest(df)
    assert forest.large is None and forest.written() is forest
    mixed = build_forest(df, hot_rows=1)
    assert sorted(mixed.placed.collect()) == sorted(forest.placed.collect())
