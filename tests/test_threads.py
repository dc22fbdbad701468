import json
import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators.threads import (
    build_forest,
    link_parents,
    resolve,
    sibling_rank,
    thread_json,
    thread_totals,
    unplaced_comments,
)
from threadlake.scratch import write_table

LAYOUT = "subreddit string, link_id string, id string, parent_id string, created_utc bigint, archive_json string"
HOT = [1_000_000, 4]
SPACINGS = [64, 2]


def record(i, parent, t, **more):
    return json.dumps({"id": i, "parent_id": parent, "created_utc": t, **more}, ensure_ascii=False)


def comments(spark, rows, link="t3_post"):
    full = [("s", r[3] if len(r) > 3 else link, r[0], r[1], r[2], record(*r[:3])) for r in rows]
    return spark.createDataFrame(full, LAYOUT)


def lines(df, forest, block_nodes=10_000, **how):
    """{(community, link): decoded line} from the fragments of each post."""
    texts = {}
    for r in thread_json(df, forest, block_nodes, **how).collect():
        assert texts.setdefault((r.subreddit, r.link_id), {}).setdefault(r.pos, r.text) == r.text
    return {k: json.loads(" ".join(t for _, t in sorted(f.items()))) for k, f in texts.items()}


def shape(nodes):
    return [(n["id"], shape(n["replies"])) for n in nodes]


def trees(df, **how):
    return {k: shape(v["tree"]) for k, v in lines(df, build_forest(df, **how)).items()}


CASES = {
    "flat": ([("a", "t3_post", 100), ("b", "t3_post", 200)], [("a", []), ("b", [])]),
    "nested": (
        [("a", "t3_post", 100), ("b", "t1_a", 150), ("c", "t1_b", 175)],
        [("a", [("b", [("c", [])])])],
    ),
    "sibling order": (
        [("a", "t3_post", 100), ("late", "t1_a", 300), ("early", "t1_a", 200)],
        [("a", [("early", []), ("late", [])])],
    ),
    "orphan": ([("a", "t3_post", 100), ("orphan", "t1_z", 150)], [("a", []), ("orphan", [])]),
    "root order": ([("second", "t3_post", 200), ("first", "t3_post", 100)], [("first", []), ("second", [])]),
    "cycle": ([("x", "t1_y", 1), ("y", "t1_x", 2), ("a", "t3_post", 3)], [("a", [])]),
    "own parent": ([("x", "t1_x", 1), ("below", "t1_x", 2)], []),
    "tie": ([("b", "t3_post", 5), ("a", "t3_post", 5)], [("a", []), ("b", [])]),
    "no parent": ([("a", None, 5), ("b", "", 6), ("c", "a", 7)], [("a", []), ("b", []), ("c", [])]),
    "no time": ([("a", "t3_post", 5), ("b", "t3_post", None)], [("b", []), ("a", [])]),
    "negative time": ([("a", "t3_post", 5), ("b", "t3_post", -5)], [("b", []), ("a", [])]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, expected = CASES[name]
    assert trees(comments(spark, rows)) == {("s", "t3_post"): expected}


def test_parents_stay_inside_their_post(spark):
    df = comments(spark, [("a", "t3_p", 1, "t3_p"), ("b", "t1_a", 2, "t3_q"), ("c", "t1_a", 3, "t3_p")])
    assert trees(df) == {("s", "t3_p"): [("a", [("c", [])])], ("s", "t3_q"): [("b", [])]}
    assert [r.id for r in link_parents(df).where("is_orphan").collect()] == ["b"]


def test_links_without_a_post(spark):
    df = comments(spark, [("a", "t3_p", 1, "t3_p"), ("b", "t3_p", 2, None), ("c", "t3_", 3, "t3_")])
    forest = build_forest(df)
    assert {k[1] for k in lines(df, forest)} == {"t3_p"}
    lost = unplaced_comments(df, forest).collect()
    assert sorted((r.id, r.reason) for r in lost) == [("b", "no post"), ("c", "no post")]


def test_equal_bare_links_stay_two_lines(spark):
    df = comments(spark, [("a", "t3_x", 1, "t3_x"), ("b", "x", 2, "x")])
    got = lines(df, build_forest(df))
    assert [v["link_id"] for v in got.values()] == ["x", "x"] and len(got) == 2


def test_record_text(spark):
    rows = [
        ("s", "t3_p", "a", "t3_p", 1, '{"id": "a", "replies": "", "body": "\\"q\\" {é} ]"}'),
        ("s", "t3_p", "b", "t1_a", 2, '{"id": "b",\t"n": 1.50 } '),
    ]
    df = spark.createDataFrame(rows, LAYOUT)
    assert lines(df, build_forest(df))["s", "t3_p"] == {
        "link_id": "p",
        "tree": [{"id": "a", "body": '"q" {é} ]', "replies": [{"id": "b", "n": 1.5, "replies": []}]}],
    }
    first, second = thread_json(df, build_forest(df)).orderBy("pos").collect()
    assert '"n": 1.50' in second.text and second.text.endswith('"replies": []}]}]}\n')


def brute_force(rows):
    """Trees per post, straight from the rules."""
    out = {}
    for link in {r[3] for r in rows}:
        mine = {r[0]: r for r in rows if r[3] == link}
        replies, roots = {i: [] for i in mine}, []
        for i, (_, parent, _, _) in mine.items():
            above = parent[3:] if parent.startswith("t1_") else None
            (replies[above] if above in mine else roots).append(i)

        def nest(ids):
            order = sorted(ids, key=lambda i: (mine[i][2], i))
            return [(i, nest(replies[i])) for i in order]

        out["s", link] = nest(roots)
    return out


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for link, size in (("t3_big", 60), ("t3_mid", 12), ("t3_one", 1), ("t3_chain", 25)):
        ids = [f"{link[3:]}{n}" for n in range(size)]
        for n, i in enumerate(ids):
            if link == "t3_chain":
                parent = f"t1_{ids[n - 1]}" if n else link
            else:
                parent = rng.choice([link, f"t1_{rng.choice(ids)}", f"t1_{ids[0]}", "t1_gone"])
            rows.append((i, parent, rng.randrange(20), link))
    return rows


@pytest.mark.parametrize("hot_rows", HOT)
@pytest.mark.parametrize("spacing", SPACINGS)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed, hot_rows, spacing):
    rows = random_rows(seed)
    df = comments(spark, rows)
    forest = build_forest(df, hot_rows=hot_rows, spacing=spacing)
    expected = brute_force(rows)
    for block_nodes in (10_000, 7, 1):
        got = {k: shape(v["tree"]) for k, v in lines(df, forest, block_nodes).items()}
        assert got == expected
    placed = forest.placed.collect()
    for link in {r[3] for r in rows}:
        mine = sorted((r.pos, r.depth) for r in placed if r.link_id == link)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        assert all(d2 <= d1 + 1 for (_, d1), (_, d2) in zip(mine, mine[1:]))
    assert len(placed) + forest.unplaced.count() == len(rows)
    resolved = resolve(df, hot_rows)
    for found in (forest, resolved):
        total = thread_totals(found).where("is_overall = 1").first()
        assert (total.posts_with_threads, total.comments_total, total.comments_in_tree) == (4, len(rows), len(placed))
    loose = [sorted(r.id for r in f.unplaced.collect()) for f in (forest, resolved)]
    assert loose[0] == loose[1]


def test_one_post_with_most_comments_is_split(spark):
    """Far more comments than a hot post may have, most of them answering one comment."""
    df = spark.range(3000).selectExpr(
        "'s' as subreddit",
        "if(id % 10 = 9, concat('t3_', id % 70), 't3_hot') as link_id",
        "cast(id as string) as id",
        "case when id % 10 = 9 or id = 0 then 't3_x' when id % 3 = 0 then 't3_hot' "
        "when id % 7 = 0 and id > 10 then concat('t1_', id - 10) else 't1_0' end as parent_id",
        "pmod(id * 7919, 1000) as created_utc",
        "concat('{\"id\": \"', id, '\"}') as archive_json",
    )
    df = write_table(df, "hot")
    cold = build_forest(df)
    hot = build_forest(df, hot_rows=100)
    assert sorted(hot.placed.collect()) == sorted(cold.placed.collect())
    assert thread_json(df, hot, 50).where("link_id = 't3_hot'").count() == 2700
    assert lines(df, hot, 50, hot_rows=100) == lines(df, cold)


def test_a_long_chain_and_a_flat_post(spark):
    """Both ways of being long are ordered by the same steps."""
    df = spark.range(5000).selectExpr(
        "'s' as subreddit", "'t3_p' as link_id", "cast(id as string) as id",
        "if(id = 0, 't3_p', concat('t1_', id - 1)) as parent_id", "id as created_utc",
        "concat('{\"id\": \"', id, '\"}') as archive_json",
    )
    placed = build_forest(df).placed.orderBy("pos").collect()
    assert [(r.id, r.depth, r.pos, r.root_id) for r in placed] == [(str(i), i, i + 1, "0") for i in range(5000)]


    flat = df.withColumn("parent_id", F.lit("t3_p")).withColumn("created_utc", -F.col("created_utc"))
    placed = build_forest(flat).placed.orderBy("pos").collect()
    assert [(r.id, r.depth, r.pos, r.root_id) for r in placed] == [(str(4999 - i), 0, i + 1, str(4999 - i)) for i in range(5000)]


def test_one_thread_whatever_the_spelling(spark):
    df = comments(spark, [("a", "t3_p", 1, "t3_p"), ("b", "t1_a", 2, "t3_p"), ("c", "t1_b", 3, "t3_p")])
    df = df.withColumn("subreddit", F.when(F.col("id") == "b", "Pics").otherwise("pics"))
    assert trees(df) == {("pics", "t3_p"): [("a", [("b", [("c", [])])])]}
    assert thread_totals(resolve(df)).where("is_overall = 0").collect()[0].posts_with_threads == 1


def test_sibling_rank(spark):
    df = comments(spark, [("a", "t3_post", 9), ("b", "t3_post", 3), ("c", "t1_a", 2), ("d", "t1_a", 1)])
    linked = write_table(link_parents(df), "linked")
    for hot_rows in (1_000_000, 1):
        got = {r.id: r.sibling for r in sibling_rank(linked, hot_rows).collect()}
        assert got == {"b": 1, "a": 2, "d": 1, "c": 2}
