"""Forum-shaped views over the supplied tables: orders are posts, line items are comments.

Every view reads its whole tables. ``oracle.py`` holds the same views as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import epoch_of_ntz
from threadlake.operators.dedup import first_wins
from threadlake.sources import spread

# The time span of the supplied orders, and the run time of the jobs.
FIRST = 788918400  # 1995-01-01
LAST = 996624000  # 2001-08-01
NOW = 1000000000
HALF_YEAR = 15778800
QUARTER = 7889400
GAP = 5000000
SPLIT = 883612800  # 1998-01-01: what is older counts as stored by an earlier run


LIVE = ("live_score", "live_num_comments", "live_refreshed_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def posts(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    key = k.cast("string")
    created = epoch_of_ntz("o_orderdate")
    title = _text("order ", key)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_orderpriority").alias("subreddit"),
        created.alias("created_utc"),
        _text("u", F.col("o_custkey").cast("string")).alias("author"),
        title.alias("title"),
        F.when(k % 50 == 1, "").when(k % 50 != 0, _text("/c/", key, "/")).alias("permalink"),
        _text("https://archive.example/c/", key).alias("url"),
        F.floor("o_totalprice").cast("bigint").alias("score"),
        (k % 100).alias("num_comments"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_self"),
        _text(
            '{"id": "', key, '", "created_utc": ', created.cast("string"), ', "title": "', title, '"}'
        ).alias("archive_json"),
        *[F.lit(None).cast("bigint").alias(c) for c in LIVE],
        (created + 60).alias("fetched_at"),
        k.alias("k"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
    )


def raw_posts(spark, sf_dir) -> DataFrame:
    """Landed post JSON with the loose values an archive has; some posts come twice."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    created = epoch_of_ntz("o_orderdate").cast("string")
    subreddit = (
        F.when(k % 11 == 0, "")
        .when(k % 11 == 1, ', "subreddit": null')
        .when(k % 11 == 2, ', "subreddit": ""')
        .otherwise(_text(', "subreddit": "', F.col("o_orderpriority"), '"'))
    )
    when = (
        F.when(k % 7 == 0, _text('"', created, '"'))
        .when(k % 7 == 1, _text(created, ".75"))
        .when(k % 7 == 2, "null")
        .otherwise(created)
    )
    self_post = (
        F.when(k % 9 == 0, "true")
        .when(k % 9 == 1, "false")
        .when(k % 9 == 2, "1")
        .when(k % 9 == 3, "0")
        .when(k % 9 == 4, '"false"')
        .when(k % 9 == 5, '""')
        .when(k % 9 == 6, "[]")
        .when(k % 9 == 7, '{"a": 1}')
        .otherwise("null")
    )
    score = F.when(k % 13 == 0, '"n/a"').otherwise((k % 1000 - 500).cast("string"))

    def record(title: str) -> Column:
        return _text(
            '{"id": "', key, '"', subreddit, ', "created_utc": ', when,
            ', "author": "u', F.col("o_custkey").cast("string"), '", "title": "', title, key,
            ' \\"q\\" é", "score": ', score, ', "is_self": ', self_post, "}",
        )

    orders = spread(table(spark, sf_dir, "orders"))
    copies = F.array(
        F.struct(F.lit(1).cast("bigint").alias("arrival"), record("order ").alias("value")),
        F.struct(
            F.lit(2).cast("bigint").alias("arrival"),
            F.when(F.col("o_orderstatus") == "P", record("edited ")).alias("value"),
        ),
    )
    return (
        orders.select(k.alias("k"), F.col("o_orderpriority").alias("requested"), F.explode(copies).alias("r"))
        .where("r.value is not null")
        .select("k", "requested", "r.arrival", "r.value")
    )


def landed_lines(spark, sf_dir) -> DataFrame:
    """Lines as they land, one per order, most of them with something that no window can hold;
    ``line_place`` is the order's number."""
    k = F.col("o_orderkey")
    key, t = k.cast("string"), epoch_of_ntz("o_orderdate").cast("string")

    def record(time: Column | str, community: str = ', "subreddit": "s"') -> Column:
        return _text('{"id": "', key, '"', community, ', "created_utc": ', time, "}")

    value = (
        F.when(k % 11 == 0, record("null"))
        .when(k % 11 == 1, record('"soon"'))
        .when(k % 11 == 2, _text("no json ", key))
        .when(k % 11 == 3, record(_text(t, "000000")))
        .when(k % 11 == 4, record(t, ""))
        .when(k % 11 == 5, record(t, ', "subreddit": ""'))
        .when(k % 11 == 6, record("-5"))
        .when(k % 11 == 7, record('"NaN"'))
        .when(k % 11 == 8, record(_text(t, ".25")))
        .otherwise(record(t))
    )
    return table(spark, sf_dir, "orders").select(
        value.alias("value"),
        F.lit(None).cast("timestamp").alias("file_time"),
        F.lit("landed").alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        k.alias("line_place"),
    )


ARRIVAL = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]


def _order_lines(spark, sf_dir) -> DataFrame:
    """Line items with what comments need of their orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    lines = spread(table(spark, sf_dir, "lineitem"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _as_comments(lines: DataFrame) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    key, line = k.cast("string"), n.cast("string")
    above = F.when(k % 2 == 1, F.floor(n / 2)).otherwise(n - 1).cast("string")
    ident = _text(key, "-", line)
    link = _text("t3_", key)
    parent = (
        F.when((k % 97 == 0) & (n == 1), _text("t1_", key, "-2"))
        .when(n == 1, link)
        .otherwise(_text("t1_", key, "-", above))
    )
    created = epoch_of_ntz("l_shipdate")
    spelling = F.when((k + n) % 10 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    author = _text("u", F.col("l_suppkey").cast("string"))
    # Numbers in more than one form, and replies as they land: empty, or a whole tree.
    extra = (
        F.when(k % 4 != 1, "")
        .when(n % 4 == 0, _text(', "replies": ""'))
        .when(n % 4 == 1, _text(', "edited": 1e2, "replies": {"kind": "Listing", "data": [{"body": "a \\"]} b", "replies": {}}, 1.50]}'))
        .when(n % 4 == 2, _text(', "z": ', created.cast("string"), '.0, "a": [1.50, {"replies": 2}]'))
        .otherwise("")
    )
    body = _text("line ", line, " of order ", key)
    return lines.select(
        ident.alias("id"),
        link.alias("link_id"),
        parent.alias("parent_id"),
        spelling.alias("subreddit"),
        created.alias("created_utc"),
        author.alias("author"),
        (F.floor("l_quantity").cast("bigint") - 10).alias("score"),
        body.alias("body"),
        _text(
            '{"id": "', ident, '", "link_id": "', link, '", "parent_id": "', parent,
            '", "subreddit": "', spelling, '", "created_utc": ',
            created.cast("string"), extra, ', "author": "', author, '", "score": ',
            (F.floor("l_quantity").cast("bigint") - 10).cast("string"), ', "body": "', body, '"}',
        ).alias("archive_json"),
        (created + 60).alias("fetched_at"),
        F.struct(*ARRIVAL).alias("arrival"),
        k.alias("k"),
        F.col("o_custkey").alias("custkey"),
    )


def raw_comments(spark, sf_dir) -> DataFrame:
    """Comment rows as landed, copies of an id included; ``arrival`` orders the copies."""
    return _as_comments(_order_lines(spark, sf_dir))


def comments(spark, sf_dir) -> DataFrame:
    """The comment store: first copy of every id. An id is the order's and the line's number, so copies
    are told apart on the line items, before their texts are made: these are not shuffled, and the
    join has brought the lines of an order together."""
    lines = first_wins(_order_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], ARRIVAL)
    return _as_comments(lines).drop("arrival")


def stored_comments(spark, sf_dir) -> DataFrame:
    """Comments an earlier run has stored."""
    return comments(spark, sf_dir).where(F.col("created_utc") < SPLIT)


def trees(spark, sf_dir) -> DataFrame:
    """Stored trees: finished orders have one."""
    p = posts(spark, sf_dir).where(F.col("status") == "F")
    return p.select(
        F.col("id").alias("link_id"), "subreddit", _text("[", F.col("id"), "]").alias("tree_json"), "fetched_at"
    )


def landed_trees(spark, sf_dir) -> DataFrame:
    """Newly landed trees, two for some posts, spelling the community in lower case."""
    p = posts(spark, sf_dir).where(F.col("score") > 200000)
    versions = F.when(F.col("num_comments") < 50, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    p = p.select("*", F.explode(versions.cast("array<bigint>")).alias("seq"))
    return p.select(
        F.col("id").alias("link_id"),
        F.lower("subreddit").alias("subreddit"),
        _text("[", F.col("id"), ",", F.col("seq").cast("string"), "]").alias("tree_json"),
        (F.col("fetched_at") + F.col("seq")).alias("fetched_at"),
        "seq",
    )


def archive(spark, sf_dir) -> DataFrame:
    """Posts and comments as one landed archive; each customer is a community."""
    community = _text("c", F.col("custkey").cast("string")).alias("subreddit")
    columns = ["id", "created_utc"]
    return (
        posts(spark, sf_dir)
        .select(F.lit("posts").alias("kind"), community, *columns)
        .unionAll(raw_comments(spark, sf_dir).select(F.lit("comments").alias("kind"), community, *columns))
    )


def _customer_kinds(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    kinds = F.array(
        F.struct(F.lit("posts").alias("kind"), (c % 5).alias("case")),
        F.struct(F.lit("comments").alias("kind"), ((c + 1) % 5).alias("case")),
    )
    return table(spark, sf_dir, "customer").select(
        c.alias("c"),
        _text("C", c.cast("string")).alias("subreddit"),
        (F.lit(FIRST) + (c % 7) * HALF_YEAR).cast("bigint").alias("since"),
        (F.lit(LAST) - (c % 11) * QUARTER).cast("bigint").alias("before"),
        F.explode(kinds).alias("x"),
    ).select("c", "subreddit", "x.kind", "x.case", "since", "before")


def requests(spark, sf_dir) -> DataFrame:
    return _customer_kinds(spark, sf_dir).select("subreddit", "kind", "since", "before")


def covered(spark, sf_dir) -> DataFrame:
    """Per case: 0 both gaps, 1 older, 2 tail, 3 nothing missing or a cover apart, 4 none."""
    rows = _customer_kinds(spark, sf_dir).where(F.col("case") != 4)
    apart = (F.col("case") == 3) & (F.col("c") % 10 == 8)
    return rows.select(
        "subreddit",
        "kind",
        F.when(F.col("case").isin(0, 1), F.col("since") + GAP)
        .when(apart, F.col("before") + 1000)
        .otherwise(F.col("since"))
        .alias("since"),
        F.when(F.col("case").isin(0, 2), F.col("before") - GAP)
        .when(apart, F.col("before") + 2000)
        .otherwise(F.col("before"))
        .alias("until"),
        F.lit(1).cast("bigint").alias("updated_at"),
    )


def outcomes(spark, sf_dir) -> DataFrame:
    """Some windows failed, some have no outcome (NULL)."""
    rows = _customer_kinds(spark, sf_dir)
    types = F.array(
        F.struct(F.lit("full").alias("window_type"), F.lit(0).alias("i")),
        F.struct(F.lit("older").alias("window_type"), F.lit(1).alias("i")),
        F.struct(F.lit("tail").alias("window_type"), F.lit(2).alias("i")),
    )
    rows = rows.select("subreddit", "kind", "c", F.explode(types).alias("w"))
    turn = F.col("c") + F.col("w.i")
    return rows.select(
        "subreddit", "kind", "w.window_type", F.when(turn % 6 != 0, turn % 4 != 0).alias("ok")
    )


def live_counts(spark, sf_dir) -> DataFrame:
    """Two visits of each post's page, the later one with every kind of count text."""
    k = F.col("k")
    p = posts(spark, sf_dir).select("id", "k", "status")
    visits = F.array(
        F.struct(
            F.lit("1").alias("score_text"), F.lit("1").alias("comments_text"), F.lit(100).alias("refreshed_at")
        ),
        F.struct(
            F.when(k % 7 == 0, F.lit("12"))
            .when(k % 7 == 1, "-3")
            .when(k % 7 == 2, "1.2k")
            .when(k % 7 == 3, None)
            .when(k % 7 == 4, "--5")
            .when(k % 7 == 5, " 5")
            .otherwise(k.cast("string"))
            .alias("score_text"),
            F.when(k % 5 == 0, None).when(k % 5 == 1, "-4").otherwise((k % 300).cast("string")).alias("comments_text"),
            F.lit(200).alias("refreshed_at"),
        ),
    )
    return p.select("id", "k", "status", F.explode(visits).alias("v")).select(
        "id", "k", "status", "v.score_text", "v.comments_text", F.col("v.refreshed_at").cast("bigint").alias("refreshed_at")
    )


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("subreddit"),
        epoch_of_ntz("ts").alias("created_utc"),
        F.col("props").alias("archive_json"),
        F.col("event_id").alias("k"),
        "value",
    )


def meta_responses(spark, sf_dir) -> DataFrame:
    """Landed community facts: responses with several rows, several responses per community."""
    c = F.col("c_custkey")
    key = c.cast("string")
    name = _text(F.col("c_mktsegment"), "/", F.col("c_nationkey").cast("string"))
    created = F.when(c % 3 == 0, "0").when(c % 3 == 1, _text("1600", F.lpad(key, 6, "0"))).otherwise("null")
    about = F.when(c % 4 == 0, "null").otherwise(_text('"about ', key, '"'))
    return table(spark, sf_dir, "customer").select(
        name.alias("subreddit"),
        F.call_function("div", c, F.lit(300).cast("bigint")).alias("response"),
        c.alias("place"),
        _text(
            '{"display_name": "', name, '", "subscribers": ', key, ', "created_utc": ', created,
            ', "public_description": ', about, "}",
        ).alias("value"),
    )


def jobs(spark, sf_dir) -> DataFrame:
    """Job rows with all forms of time spec, one per order."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        _text(" a", (k % 97).cast("string"), ", b", (k % 89).cast("string"), ",, ").alias("subreddits"),
        F.when(k % 12 == 0, None)
        .when(k % 12 == 1, "all")
        .when(k % 12 == 2, " NOW ")
        .when(k % 12 == 3, (k * 1000).cast("string"))
        .when(k % 12 == 4, _text((k % 20).cast("string"), "y"))
        .when(k % 12 == 5, _text((k % 200).cast("string"), " M"))
        .when(k % 12 == 6, _text("  ", (k % 900).cast("string"), "D "))
        .when(k % 12 == 7, _text(key, "h"))
        .when(k % 12 == 8, day)
        .when(k % 12 == 9, F.regexp_replace(day, "-0", "-"))
        .when(k % 12 == 10, _text("2023-02-", (k % 40).cast("string")))
        .otherwise(_text(key, "w"))
        .alias("since_spec"),
        F.when(k % 5 == 0, None)
        .when(k % 5 == 1, "now")
        .when(k % 5 == 2, "ALL")
        .when(k % 5 == 3, _text((k % 400).cast("string"), "d"))
        .otherwise(day)
        .alias("until_spec"),
        (k % 2 == 0).alias("fetch_posts"),
        (k % 3 == 0).alias("fetch_comments"),
        (k % 5 == 0).alias("fetch_trees"),
        (k % 7 == 0).alias("fetch_meta"),
    )


def names(spark, sf_dir) -> DataFrame:
    """Fullnames of every shape, one per order."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.when(k % 8 == 0, None)
        .when(k % 8 == 1, "")
        .when(k % 8 == 2, "t3_")
        .when(k % 8 == 3, key)
        .when(k % 8 == 4, _text("t1_", key, "_x"))
        .when(k % 8 == 5, _text("_", key))
        .when(k % 8 == 6, _text("t1_", key))
        .otherwise(_text("t3_", key))
        .alias("fullname"),
    )
