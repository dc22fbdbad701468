import csv
import glob
import io
import json

from threadlake.operators.threads import build_forest, thread_json
from threadlake.schemas import COMMENTS, POSTS
from threadlake.sinks import append_jsonl, append_trees, write_csv, write_threads

NO_LIVE = (None, None, None)


def content(pattern):
    """Text of the part files in name order, byte for byte."""
    return [open(f, newline="", encoding="utf-8").read() for f in sorted(glob.glob(str(pattern)))]


def posts(spark, *rows):
    full = [(i, s, t, None, title, None, "", 1, None, 0, json.dumps({"id": i, "t": title}, ensure_ascii=False), *NO_LIVE, 0) for i, s, t, title in rows]
    return spark.createDataFrame(full, POSTS)


def test_csv(spark, tmp_path):
    rows = posts(spark, ("b", "S", 2, 'say "é", ok'), ("a", "S", 1, " two\nlines "), ("c", "T", 3, None))
    write_csv(rows, str(tmp_path), "posts")
    texts = content(tmp_path / "posts.csv" / "community=S" / "*.txt")
    text = texts[0] + "".join(t.split("\r\n", 1)[1] for t in texts[1:])
    expected = io.StringIO(newline="")
    writer = csv.writer(expected, lineterminator="\r\n")
    writer.writerow(POSTS.names[:10] + ["live_score", "live_num_comments", "live_refreshed_at"])
    writer.writerow(["a", "S", 1, None, " two\nlines ", None, "", 1, None, 0, None, None, None])
    writer.writerow(["b", "S", 2, None, 'say "é", ok', None, "", 1, None, 0, None, None, None])
    assert text == expected.getvalue()
    # A second export replaces the communities it holds and leaves the others.
    write_csv(posts(spark, ("z", "S", 1, "new")), str(tmp_path), "posts")
    assert [r["id"] for t in content(tmp_path / "posts.csv" / "community=S" / "*.txt") for r in csv.DictReader(io.StringIO(t, newline=""))] == ["z"]
    assert content(tmp_path / "posts.csv" / "community=T" / "*.txt")


def test_jsonl_appends(spark, tmp_path):
    append_jsonl(posts(spark, ("b", "S", 2, "é"), ("a", "S", 1, 'q"')), str(tmp_path), "posts")
    append_jsonl(posts(spark, ("c", "S", 3, "x")), str(tmp_path), "posts")
    append_jsonl(posts(spark), str(tmp_path), "posts")
    append_jsonl(posts(spark, ("d", "S", 3, "x")), str(tmp_path), "posts", enabled=False)
    lines = "".join(content(tmp_path / "posts.jsonl" / "subreddit=S" / "*.txt")).splitlines()
    assert sorted(lines) == ['{"id": "a", "t": "q\\""}', '{"id": "b", "t": "é"}', '{"id": "c", "t": "x"}']


def test_tree_lines(spark, tmp_path):
    trees = spark.createDataFrame([('p"1', "S", "[{}]")], "link_id string, subreddit string, tree_json string")
    append_trees(trees, str(tmp_path))
    (text,) = content(tmp_path / "comment_trees.jsonl" / "subreddit=S" / "*.txt")
    assert json.loads(text) == {"link_id": 'p"1', "tree": [{}]}


def test_thread_lines(spark, tmp_path):
    def build(*ids):
        rows = [
            (i, "t3_p" if i < "m" else "t3_q", "t3_p", "S", n, None, None, None, json.dumps({"id": i, "b": 'x"\n'}), 0)
            for n, i in enumerate(ids)
        ]
        df = spark.createDataFrame(rows, COMMENTS)
        write_threads(thread_json(df, build_forest(df), block_nodes=2), str(tmp_path))
        lines = "".join(content(tmp_path / "threads.jsonl" / "subreddit=s" / "*.txt")).split("\n")
        assert not lines[-1].strip()
        return [json.loads(x) for x in lines[:-1]]

    p, q = build("a", "b", "c", "z")
    assert (p["link_id"], q["link_id"]) == ("p", "q") and set(p) == set(q) == {"link_id", "tree"}
    assert [n["id"] for n in p["tree"]] == ["a", "b", "c"] and p["tree"][0]["b"] == 'x"\n'
    assert [x["link_id"] for x in build("a")] == ["p"]


def test_line_of_a_large_post(spark, tmp_path):
    """Far more comments than a block holds: one line like any other."""
    df = spark.range(25_000).selectExpr(
        "'S' as subreddit", "'t3_p' as link_id", "cast(id as string) as id",
        "if(id % 5 = 0, 't3_p', concat('t1_', id - 1)) as parent_id", "id as created_utc",
        "concat('{\"id\": \"', id, '\"}') as archive_json",
    )
    write_threads(thread_json(df, build_forest(df)), str(tmp_path))
    (line, rest) = "".join(content(tmp_path / "threads.jsonl" / "subreddit=s" / "*.txt")).split("\n")
    chain = lambda i: {"id": str(i), "replies": [chain(i + 1)] if i % 5 < 4 else []}
    assert json.loads(line) == {"link_id": "p", "tree": [chain(i) for i in range(0, 25_000, 5)]}
    assert not rest.strip()
