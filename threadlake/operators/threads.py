"""Reply trees from flat comments.

Joins run on a comment's number, never on the post alone, so a post that holds a large share of all
comments spreads over many tasks; keys that many rows share (a comment with very many replies) are
dealt by ``skew``.

1. ``link_parents``: a reply finds its parent inside its post; without one it is a root.
2. ``resolve``: which comments a root leads to. Open replies jump over one another, the distance
   doubling every round; a reply whose target is not open has been led to. Only open replies are
   looked at, so what is left when a round frees none are cycles and what hangs below them.
3. ``build_forest``: order, depth and root. Posts of at most ``TOGETHER`` comments are brought together,
   one shuffle for all, and placed side by side in their tasks (``small_posts``). In a larger post
   they follow from one walk through it in reading order, spread over many tasks. Every
   comment knows the one before it and how much deeper or higher that lies. Sums along the walk back to
   its start (comments passed; steps down less steps up; nearest top comment) are place, depth and
   root. They are found by list ranking: about one step in ``SPACING`` is a splitter, picked by a hash; every step jumps, in
   doubling distances, until it meets a splitter or the start; then the splitters, which are few, do
   the same among themselves, and each step adds what its splitter has found. Neither trees of any
   depth nor flat posts of any size are treated in a way of their own, and nothing but numbers and
   the id of the top comment is carried along.
4. ``thread_json``: one text fragment per comment, whatever the size of its post. A post's
   fragments in order, with blanks between them, are its line; the sink only streams them.

Communities match whatever their case: a post's comments are one thread however they spell it, and
results name the community in lower case.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions import drop_json_field, json_quote, parent_kind, strip_fullname
from threadlake.functions.names import COMMENT_KIND
from threadlake.scratch import Scratch

from . import small_posts
from .skew import HOT_ROWS, hot_keys, lookup, neighbours_in_groups, rank_in_groups, split_hot

# Keys run from many values to few: sorts compare the first key first, and a community name decides
# next to nothing.
POST = ["link_id", "subreddit"]
SPACING = 256  # steps of a walk between splitters, on average; results do not depend on it
TOGETHER = 10_000  # comments of a post that one task places; results do not depend on it
BLOCK_NODES = 10_000  # comments whose neighbours are found in one window; results do not depend on it


class Forest(NamedTuple):
    """``placed``: subreddit, link_id, id, parent, root_id, depth, pos (1.. in reading order).
    ``unplaced``: subreddit, link_id, id, parent of comments no root leads to. Both rest on tables in
    ``scratch``. From ``resolve``, ``placed`` has no root, depth and place. ``small``: rows of small
    posts, written, with ``_size`` (placed comments of the post) and the depths ``_before`` and ``_after``
    in reading order; ``large``: ``placed`` of the other posts, if there are any."""

    placed: DataFrame
    unplaced: DataFrame
    scratch: Scratch
    small: DataFrame | None = None
    large: DataFrame | None = None

    def written(self) -> Forest:
        """The same with ``placed`` written, for more than one use."""
        if hasattr(self.placed, "_scratch_path") or self.small is not None and self.large is None:
            return self
        if self.large is None:
            return self._replace(placed=self.scratch.write(self.placed, "placed"))
        if hasattr(self.large, "_scratch_path"):
            return self
        large = self.scratch.write(self.large, "placed")
        return self._replace(placed=_small_placed(self.small).unionByName(large), large=large)


def _small_placed(small: DataFrame) -> DataFrame:
    return small.where(F.col("pos").isNotNull()).drop("_size", "_before", "_after")


def _community() -> Column:
    return F.lower("subreddit").alias("subreddit")


def in_threads(comments: DataFrame) -> DataFrame:
    """Comments that name a post, their community folded."""
    named = comments.where(F.coalesce(strip_fullname("link_id"), F.lit("")) != "")
    return named.withColumn("subreddit", F.lower("subreddit"))


def _keys(comments: DataFrame) -> DataFrame:
    """POST, id, created_utc, and the id a reply names (NULL for roots)."""
    named = F.when(parent_kind("parent_id") == COMMENT_KIND, strip_fullname("parent_id"))
    created = F.coalesce("created_utc", F.lit(0)).cast("bigint").alias("created_utc")
    return in_threads(comments).select(*POST, "id", created, named.alias("_named"))


def _linked(comments: DataFrame, scratch: Scratch, hot_rows: int) -> tuple[DataFrame, int]:
    """Numbered comments (POST, id, created_utc, node), the node and id of their parent (NULL for
    roots) and ``is_orphan``, written; and their number."""
    nodes = _keys(comments).withColumn("node", F.monotonically_increasing_id())
    nodes, n_replies = scratch.write_counted(nodes, "nodes", F.col("_named").isNotNull())
    known = nodes.select(*POST, F.col("id").alias("_named"), F.col("node").alias("_parent"))
    replies = nodes.where(F.col("_named").isNotNull())
    linked = lookup(replies, known, ["_named", *POST], "left", hot_rows, n_replies)
    # Roots have no key to look up: shuffled with the rest they would all meet in one task.
    tops = nodes.where(F.col("_named").isNull()).withColumn("_parent", F.lit(None).cast("bigint"))
    columns = [*POST, "id", "created_utc", "node"]
    linked = tops.unionByName(linked).select(
        *columns,
        F.col("_parent").alias("parent_node"),
        F.when(F.col("_parent").isNotNull(), F.col("_named")).alias("parent"),
        (F.col("_named").isNotNull() & F.col("_parent").isNull()).alias("is_orphan"),
    )
    return scratch.write_counted(linked, "linked", F.col("parent_node").isNotNull())


def link_parents(comments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each comment with the id of its ``parent`` (NULL for roots) and ``is_orphan``.

    ``comments`` has unique ids; only its key columns are read.
    """
    linked, _ = _linked(comments, Scratch(comments.sparkSession, "links"), hot_rows)
    return linked.drop("node", "parent_node")


def _open_replies(linked: DataFrame, replies: int, scratch: Scratch, hot_rows: int) -> DataFrame:
    """Nodes that no root leads to."""
    live = linked.where(F.col("parent_node").isNotNull()).select("node", F.col("parent_node").alias("ahead"))
    n, written = replies, None
    while n:
        targets = live.select(F.col("node").alias("ahead"), F.col("ahead").alias("_beyond"))
        step = lookup(live, targets, ["ahead"], "inner", hot_rows, n).select("node", F.col("_beyond").alias("ahead"))
        step, left = scratch.write_counted(step, "open", F.lit(True))
        if written is not None:
            scratch.drop(written)
        live = written = step
        if left == n:
            break
        n = left
    return live.select("node")


def resolve(comments: DataFrame, hot_rows: int = HOT_ROWS) -> Forest:
    """Which comments are in a tree, without their order."""
    scratch = Scratch(comments.sparkSession, "threads")
    linked, replies = _linked(comments, scratch, hot_rows)
    loose = _open_replies(linked, replies, scratch, hot_rows)
    columns = [*POST, "id", "parent"]
    placed = linked.join(loose, "node", "left_anti").select(*columns)
    return Forest(placed, linked.join(loose, "node", "left_semi").select(*columns), scratch)


def build_forest(comments: DataFrame, hot_rows: int = HOT_ROWS, spacing: int = SPACING) -> Forest:
    """The forest of ``comments``, a written table."""
    keys = in_threads(comments)
    large = hot_keys(keys, POST, min(hot_rows, TOGETHER))
    scratch = Scratch(comments.sparkSession, "threads")
    few, many = (keys, None) if large is None else split_hot(keys, large, POST)
    if few is None:
        return _walked(many, scratch, hot_rows, spacing)
    small = scratch.write(small_posts.placed(_keys(few), F.col("_named")), "small")
    loose = small.where(F.col("pos").isNull()).select(*POST, "id", "parent")
    if many is None:
        return Forest(_small_placed(small), loose, scratch, small)
    walked = _walked(many, scratch, hot_rows, spacing)
    placed = _small_placed(small).unionByName(walked.placed)
    return Forest(placed, loose.unionByName(walked.unplaced), scratch, small, walked.placed)


def _walked(comments: DataFrame, scratch: Scratch, hot_rows: int, spacing: int) -> Forest:
    """The forest by a walk through each post."""
    linked, _ = _linked(comments, scratch, hot_rows)
    steps = scratch.write(_walk(linked, hot_rows), "steps")
    ranked = _ranked(steps, scratch, spacing)
    entered = ranked.where(F.col("at") % 2 == 0).select(
        F.call_function("div", F.col("at"), F.lit(2).cast("bigint")).alias("node"),
        F.col("entered").alias("pos"),
        (F.col("level") - 1).cast("int").alias("depth"),
        F.col("top").alias("root_id"),
    )
    placed = linked.join(entered, "node").select(*POST, "id", "parent", "root_id", "depth", "pos")
    loose = linked.join(entered.select("node"), "node", "left_anti").select(*POST, "id", "parent")
    return Forest(placed, loose, scratch)


def _walk(linked: DataFrame, hot_rows: int) -> DataFrame:
    """Steps of the walk: ``at`` is 2 * node for coming to a comment, 2 * node + 1 for having passed all
    its replies, if it has any; ``to`` is the step before (NULL at the start of a post); the rest is
    what the step itself adds to the sums.

    A comment is passed with its last reply, or by coming to it if it has none: its ``exit``. Before a
    first reply stands the coming to its parent, before any other one the exit of its elder sibling.
    """
    family = ["parent_node", *POST]
    parents = linked.where(F.col("parent_node").isNotNull()).select(F.col("parent_node").alias("node")).distinct()
    kin = linked.select(*family, "node", "id", "created_utc").join(
        parents.withColumn("_has_replies", F.lit(1)), "node", "left"
    )
    kin = kin.withColumn("exit", F.col("node") * 2 + F.coalesce("_has_replies", F.lit(0)))
    kin = neighbours_in_groups(kin, family, ["created_utc", "id"], "exit", hot_rows, rows=linked.count())
    one, parent = F.lit(1).cast("bigint"), F.col("parent_node")
    comes = F.struct(
        (F.col("node") * 2).alias("at"),
        F.coalesce("_before", parent * 2).alias("to"),
        one.alias("entered"),
        one.alias("level"),
        F.when(parent.isNull(), F.col("id")).alias("top"),
    )
    # Passed by coming to it, a comment without replies leaves the level as it was.
    stays = F.col("_before").isNotNull() & (F.col("_before") % 2 == 0)
    comes = comes.withField("level", F.when(stays, one - 1).otherwise(one))
    passes = F.struct(
        (parent * 2 + 1).alias("at"),
        F.col("exit").alias("to"),
        (one - 1).alias("entered"),
        F.when(F.col("exit") % 2 == 0, -one - 1).otherwise(-one).alias("level"),
        F.lit(None).cast("string").alias("top"),
    )
    steps = F.array_compact(F.array(comes, F.when(F.col("_is_last") & parent.isNotNull(), passes)))
    return kin.select(F.explode(steps).alias("s")).select("s.*")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _jumped(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """Steps moved on to where the steps they point at point; what both have found is added up."""
    beyond = targets.select(
        F.col("at").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("to", "entered", "level", "top")]
    )
    return steps.join(beyond, "to").select(
        "at",
        F.col("_to").alias("to"),
        (F.col("entered") + F.col("_entered")).alias("entered"),
        (F.col("level") + F.col("_level")).alias("level"),
        F.coalesce("top", "_top").alias("top"),
    )


def _jump_until(steps: DataFrame, arrived: Column, targets: Column, scratch: Scratch) -> list[DataFrame]:
    """Steps moved on in doubling distances until ``arrived``; those that never do (they run in a
    ring) are left out. Only steps that are ``targets`` are jumped to. No two steps have the same
    target, so no join key repeats."""
    done, live = [steps.where(arrived)], steps.where(~arrived)
    n = None
    while True:
        pool = _union([*done, live]).where(targets)
        moved, left = scratch.write_counted(_jumped(live, pool), "steps", ~arrived)
        done.append(moved.where(arrived))
        if not left or left == n:
            return done
        live, n = moved.where(~arrived), left


def _ranked(steps: DataFrame, scratch: Scratch, spacing: int) -> DataFrame:
    """Sums from each step back to the start of its walk; steps on rings are left out."""

    def splits(step: str) -> Column:
        return F.pmod(F.xxhash64(step), F.lit(spacing)) == 0

    start = F.col("to").isNull()
    met = F.coalesce(splits("to"), F.lit(False)) | start
    near = _union(_jump_until(steps, met, ~splits("at"), scratch))
    splitters = scratch.write(near.where(splits("at")), "splitters")
    far = _union(_jump_until(splitters, start, F.lit(True), scratch))
    return near.where(start).unionByName(_jumped(near.where(~start), far))


def sibling_rank(nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Place of each comment among its siblings (roots are siblings of each other).

    ``nodes`` is a written table with subreddit, link_id, id, parent, created_utc.
    """
    return rank_in_groups(nodes, ["parent", *POST], ["created_utc", "id"], "sibling", hot_rows)


def unplaced_comments(comments: DataFrame, forest: Forest) -> DataFrame:
    """Comments in no tree and why: in or below a reply cycle, or without a post."""
    loose = comments.where(F.coalesce(strip_fullname("link_id"), F.lit("")) == "")
    loose = loose.withColumn("subreddit", F.lower("subreddit"))
    return forest.unplaced.select(*POST, "id", F.lit("cycle").alias("reason")).unionByName(
        loose.select(*POST, "id", F.lit("no post").alias("reason"))
    )


def post_counts(forest: Forest) -> DataFrame:
    """Comments of each post, and those in a tree."""
    marked = forest.placed.select(*POST, F.lit(1).alias("_in")).unionAll(
        forest.unplaced.select(*POST, F.lit(0).alias("_in"))
    )
    return marked.groupBy(*POST).agg(F.count("*").alias("comments"), F.sum("_in").alias("in_tree"))


def rolled_up(per_post: DataFrame) -> DataFrame:
    """Threads and comments per community, and overall (``is_overall`` = 1)."""
    return per_post.rollup("subreddit").agg(
        F.grouping("subreddit").cast("int").alias("is_overall"),
        F.count("*").alias("posts_with_threads"),
        F.sum("comments").alias("comments_total"),
        F.sum("in_tree").alias("comments_in_tree"),
    )


def thread_totals(forest: Forest) -> DataFrame:
    return rolled_up(post_counts(forest))


def _with_neighbours(placed: DataFrame, block_nodes: int, hot_rows: int) -> DataFrame:
    """Placed comments with ``_size``, ``_before`` and ``_after``."""
    size = F.lit(block_nodes).cast("bigint")
    sizes = placed.groupBy(*POST).agg(F.count("*").alias("_size"))
    placed = lookup(placed.select(*POST, "id", "depth", "pos"), sizes, POST, "inner", hot_rows)
    # Neighbours are found on narrow rows, in blocks of a post; a block also sees the row on
    # either side of it.
    block = F.call_function("div", F.col("pos") - 1, size)
    seen_in = F.array_compact(
        F.array(
            block,
            F.when((F.col("pos") - 1) % size == 0, F.when(block > 0, block - 1)),
            F.when(F.col("pos") % size == 0, block + 1),
        )
    )
    window = Window.partitionBy(*POST, "_block").orderBy("pos")
    return (
        placed.select("*", block.alias("_own"), F.explode(seen_in).alias("_block"))
        .select(
            "*",
            F.lag("depth").over(window).alias("_before"),
            F.lead("depth").over(window).alias("_after"),
        )
        .where(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )


def thread_json(
    comments: DataFrame,
    forest: Forest,
    block_nodes: int = BLOCK_NODES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The line of each post as fragments: (subreddit, link_id, pos, text), one per placed comment.

    A post's texts in the order of ``pos``, joined with or without blanks, are its JSON object and
    a line feed. A post whose comments all hang in cycles has one fragment, an empty tree.
    """
    forest = forest.written()
    columns = [*POST, "id", "depth", "pos", "_size", "_before", "_after"]
    known = [] if forest.small is None else [forest.small.where(F.col("pos").isNotNull()).select(*columns)]
    if forest.small is None or forest.large is not None:
        rest = forest.placed if forest.small is None else forest.large
        known.append(_with_neighbours(rest, block_nodes, hot_rows).select(*columns))
    around = _union(known)
    some = forest.placed.select(*POST).distinct()
    records = in_threads(comments).select(*POST, "id", drop_json_field("archive_json", "replies").alias("record"))
    shaped = around.join(records, ["id", *POST], "inner")

    depth, before, after = F.col("depth"), F.col("_before"), F.col("_after")
    head = F.concat(F.lit('{"link_id": '), json_quote(strip_fullname("link_id")), F.lit(', "tree": ['))
    record = F.rtrim("record", F.lit(" \r\n\t"))
    # A comment closes itself and the ancestors that the next comment is not under.
    closed = F.greatest(depth - F.coalesce(after, F.lit(0)) + 1, F.lit(0))
    text = F.concat(
        F.when(F.col("pos") == 1, head).when(before >= depth, ", ").otherwise(""),
        record.substr(F.lit(1), F.length(record) - 1),
        F.lit(', "replies": ['),
        F.repeat(F.lit("]}"), closed.cast("int")),
        F.when(F.col("pos") == F.col("_size"), "]}\n").otherwise(""),
    )
    nothing = forest.unplaced.select(*POST).distinct().join(some, POST, "left_anti")
    return shaped.select(*POST, "pos", text.alias("text")).unionByName(
        nothing.select(
            *POST, F.lit(1).cast("bigint").alias("pos"), F.concat(head, F.lit("]}\n")).alias("text")
        )
    )
