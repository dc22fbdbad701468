"""Near-duplicate classes: BagMinHash bands give candidates, bags of shingles are compared exactly.

1. Exact copies are one text (by MD5) from the start.
2. Texts that agree in a whole band of their signatures share a bucket. In each bucket all members
   are compared with one of them, the hub: n - 1 comparisons, not n * n / 2.
3. Links (similarity of ``least`` or more) are joined to classes.
4. Members that are in another class than their hub are left over; they may be linked to other
   members of the bucket, and two exact bounds find those (see ``_LeftOver``): what a text shares
   with others beyond the hub's shingles must make up for what it lacks, so only pairs that share
   one of the rarest such shingles, or whose other text is smaller than the hub, can be linked.
   Shingles that only one class holds make no pairs. Where the pairs were many more than the members,
   the members that share such a shingle are first compared with one of them, a hub of their own,
   and joined to classes, as often as this links many of them; only what is in different classes
   after that is compared pair by pair.

So a group of copies with a third of all texts costs comparisons in proportion to its size, no
bucket is capped, and no link within a bucket between texts of different classes is missed. Two texts with similarity 0.8
share a bucket with a probability of 0.9996 (20 bands of 5 values).

Results: one row for each row of the input. The class id is the smallest id in the class. A null
text, or one without words, is alone in its class, whatever its copies, and its class id is its own
id. Null ids never become class ids unless a class has no other. Repeated rows fall into one class.
Documents of one id with different texts are different texts. Further columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import bagminhash
from threadlake.llm.frames import add_columns, text_of
from threadlake.operators.skew import lookup
from threadlake.scratch import Scratch


# The classes depend on neither of these, but on the bounds alone.
FEW_PAIRS = 4  # pairs per member that are compared at once
LEAST_GAIN = 10  # members get hubs of their own again if one in so many was linked by the last ones


@dataclass(frozen=True)
class Settings:
    bands: int = 20
    rows: int = 5
    least: float = 0.8


EDGES_PER_TASK = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest node of what they join."""
    above: dict = {}
    types = None

    def top(x):
        path = []
        while (y := above.get(x, x)) != x:
            path.append(x)
            x = y
        for z in path:
            above[z] = x
        return x

    for batch in batches:
        types = batch.schema.types
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((top(a), top(b)))
            above[b] = a
    if types is not None:
        nodes = [x for x in list(above) if top(x) != x]
        columns = [pa.array(c, t) for c, t in zip((nodes, [top(x) for x in nodes]), types)]
        yield pa.RecordBatch.from_arrays(columns, names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is its smallest node.

    Tasks of about ``EDGES_PER_TASK`` edges make a forest of stars each, which is the result where one
    task holds all edges. The forests are joined by alternating large-star and small-star steps, each
    a few joins and aggregations over the edges, until nothing changes. Nothing but counts and a
    checksum reaches the driver.
    """

    def named(stars: DataFrame) -> DataFrame:
        roots = stars.select("v").distinct().select(F.col("v").alias("node"), "v")
        return stars.select(F.col("u").alias("node"), "v").unionByName(roots).select(
            "node", F.col("v").alias("component")
        )

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        sums = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")
        table = scratch.write(e.observe(seen, *sums), "edges")
        return table, (seen.get.get("n"), seen.get.get("x"))

    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
    forest = edges.coalesce(tasks).mapInArrow(_forest, f"u {kind}, v {kind}")
    if tasks == 1:
        return named(scratch.write(forest, "edges"))
    now, state = written(forest.distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, change = written(
            small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        )
        scratch.drop(now)
        now, same = after, change == state
        state = change
        if same:
            return named(now)


_NUMBERS = ("similarity", "common", "left_size", "right_size")
_COMPARED = pa.schema(
    [("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64()), ("common", pa.int64()),
     ("left_size", pa.int64()), ("right_size", pa.int64()), ("rest", pa.list_(pa.int64()))]
)
_COMPARED_DDL = (
    "a binary, b binary, similarity double, common bigint, left_size bigint, right_size bigint, "
    "rest array<bigint>"
)


def _compare(with_rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lengths = bagminhash.byte_lengths(left) + bagminhash.byte_lengths(right)
            for s in bagminhash.slices(lengths):
                size = s.stop - s.start
                found = bagminhash.compare(left.slice(s.start, size), right.slice(s.start, size))
                counts = found["rest_counts"] * with_rest
                rest = found["rest"].view(np.int64)[: counts.sum()]
                ends = np.append(0, np.cumsum(counts))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest))
                columns = [batch.column(i).slice(s.start, size) for i in (0, 1)]
                columns += [pa.array(found[name]) for name in _NUMBERS]
                yield pa.RecordBatch.from_arrays([*columns, lists], schema=_COMPARED)

    return run


def compare(pairs: DataFrame, texts: DataFrame, with_rest: bool = False) -> DataFrame:
    """Similarity of each pair (a, b) of keys in ``texts`` (key, text), and what it is made of.

    ``rest`` lists the shingles of which ``a`` has more than ``b``; it is empty unless asked for.
    """
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compare(with_rest), _COMPARED_DDL)


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    named = classes.select(F.col("node").alias("key"), "component")
    return rows.join(named, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )


class _LeftOver:
    """Pairs (a, b) that may be linked although their hub does not join their classes.

    Let y share ``common`` shingles with the hub, and let ``found`` of those it has beyond the hub
    be in a text of that hub that is in another class. A text z with as many as ``size`` shingles is
    linked to y only if they share least / (1 + least) * (size(y) + size(z)) of them.

    * If z shares none of what y has beyond the hub, they share no more than ``common``, so z must
      be no larger than common * (1 + 1 / least) - size(y). Such pairs are found by size.
    * Otherwise they share at least ``needed`` = that number - common shingles beyond the hub, so
      all but needed - 1 of y's found ones hold at least one that z has. The rarest ones are used,
      and behind their first common one both must still hold as many as the pair needs.

    And as 1 - similarity is a metric, their distances to the hub differ by no more than 1 - least.

    ``placed``: hub, key, d, size, common, component, over; ``distance``: hub, key, rest.
    """

    def __init__(self, placed: DataFrame, distance: DataFrame, settings: Settings, scratch: Scratch) -> None:
        self.least, self.scratch = settings.least, scratch
        share = self.share = settings.least / (1 + settings.least)
        hubs = placed.where("over").select("hub").distinct()
        self.group = placed.join(hubs, "hub", "left_semi")
        self.smallest = self.group.groupBy("hub").agg(F.min("size").alias("smallest"))
        beyond = self.group.join(distance.select("hub", "key", "rest"), ["hub", "key"])
        beyond = beyond.select(*self.group.columns, F.explode("rest").alias("shingle"))
        # A shingle that the members of one class alone hold makes no pair.
        held = (
            beyond.groupBy("hub", "shingle")
            .agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
            .where(F.col("x") != F.col("y"))
            .drop("x", "y")
        )
        by_text = Window.partitionBy("hub", "key")
        found = (
            beyond.join(held, ["hub", "shingle"])
            .withColumn("found", F.count("*").over(by_text))
            .withColumn("place", F.row_number().over(by_text.orderBy("n", "shingle")))
            .groupBy(*self.group.columns, "shingle", "found")
            .agg(F.min("place").alias("place"))
            .join(self.smallest, "hub")
        )
        needed = F.ceil(share * (F.col("size") + F.col("smallest")) - F.col("common") - 1e-6)
        rare = F.col("over") & (F.col("place") <= F.col("found") - F.greatest(needed, F.lit(1)) + 1)
        self.found = scratch.write(found.withColumn("rare", rare), "found")

    def _side(self, rows: DataFrame, name: str, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
        columns = ("key", "d", "size", "common", "component", *more)
        return rows.select("hub", *keys, *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def _linkable(self) -> Column:
        reach = 1 - self.least + 1e-9
        return (
            (F.col("component_y") != F.col("component_z"))
            & (F.abs(F.col("d_y") - F.col("d_z")) <= reach)
            & (F.least("size_y", "size_z") >= self.least * F.greatest("size_y", "size_z") - 1e-6)
        )

    def _enough(self) -> Column:
        """From their first common shingle on, both must hold as many as the pair needs."""
        needed = self.share * (F.col("size_y") + F.col("size_z")) - F.least("common_y", "common_z")
        behind = F.least(F.col("found_y") - F.col("place_y"), F.col("found_z") - F.col("place_z"))
        return behind + 1 >= needed - 1e-6

    def _pairs(self, joined: DataFrame) -> DataFrame:
        return joined.select(
            F.greatest("key_y", "key_z").alias("a"), F.least("key_y", "key_z").alias("b")
        ).distinct()

    def work(self) -> tuple[int, int]:
        """Rows of members that look for partners, and of the pairs they would make."""
        sums = self.found.groupBy("hub", "shingle").agg(
            F.count_if("rare").alias("rare"), F.count("*").alias("n")
        )
        row = sums.agg(F.sum("rare"), F.sum(F.col("rare") * (F.col("n") - 1))).first()
        return row[0] or 0, row[1] or 0

    def with_own_hubs(self) -> DataFrame:
        """Each such member with one holder of its shingle, the one nearest to the hub."""
        places = ("found", "place")
        centre = F.min_by(F.struct("key", "d", "size", "common", "component", *places), F.struct("d", "key"))
        centres = self.found.groupBy("hub", "shingle").agg(centre.alias("c"))
        centres = self._side(centres.select("hub", "shingle", "c.*"), "z", "shingle", more=places)
        rare = self._side(self.found.where("rare"), "y", "shingle", more=places)
        return self._pairs(rare.join(centres, ["hub", "shingle"]).where(self._linkable()))

    def all(self) -> DataFrame:
        """Every pair that may be linked."""
        places = ("found", "place")
        sharing = self._side(self.found.where("rare"), "y", "shingle", more=places)
        sharing = sharing.join(self._side(self.found, "z", "shingle", more=places), ["hub", "shingle"])
        sharing = sharing.where(self._enough() & self._linkable())
        limit = F.col("common") * (1 + 1 / self.least) - F.col("size")
        roomy = self.group.where("over").join(self.smallest, "hub").where(F.col("smallest") <= limit + 1e-6)
        needed = self.share * (F.col("size_y") + F.col("size_z"))
        small = F.least("common_y", "common_z") >= needed - 1e-6
        smaller = self._side(roomy, "y").join(self._side(self.group, "z"), "hub").where(small & self._linkable())
        columns = ("key_y", "key_z")
        return self._pairs(sharing.select(*columns).unionByName(smaller.select(*columns)))


def _placed(distance: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with their hubs and classes; ``over`` where these differ. A hub may have very many."""
    hubs = distance.select(F.col("hub").alias("key")).distinct()
    of_hub = _with_class(hubs, classes).select(F.col("key").alias("hub"), F.col("component").alias("hub_class"))
    rows = lookup(_with_class(distance.drop("rest"), classes), of_hub, ["hub"], "inner")
    return rows.withColumn("over", F.col("component") != F.col("hub_class")).drop("hub_class")


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    id: str = "doc_id",
    text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """(id, class_id) for every row of ``docs``."""
    content = text_of(text)
    given = docs.select(
        F.col(id).alias("id"),
        F.when(content.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(content.cast("binary")))).alias("key"),
        content.alias("text"),
    )

    def sign(texts: pa.Array) -> list[pa.Array]:
        keys, has = bagminhash.bands(texts, settings.bands, settings.rows)
        ends = np.concatenate([[0], np.cumsum(has)]) * settings.bands
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[has].ravel()))]

    signed = scratch.write(
        add_columns(given, sign, ["text"], "bands array<bigint>", ("text",)), "signed"
    )
    texts = scratch.write(
        signed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("id").alias("first_id"), F.first("bands").alias("bands")),
        "unique",
    )

    entries = texts.select("key", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"))
    shared = scratch.write(entries.join(sizes.where(F.col("n") > 1), "bucket"), "shared")
    # The hub is the member with most company, so that a group of copies has one hub in all buckets.
    company = shared.groupBy("key").agg(F.sum("n").alias("company"))
    hubs = shared.join(company, "key").groupBy("bucket")
    hubs = hubs.agg(F.max(F.struct("company", "key"))["key"].alias("hub"))
    members = scratch.write(shared.drop("n").join(hubs, "bucket"), "members")
    scratch.drop(shared)
    # One row per text that is ever compared; rows repeated under one id change nothing.
    needed = members.select("key").distinct().join(texts.select("key", "first_id"), "key")
    same_row = (given["key"] == needed["key"]) & given["id"].eqNullSafe(needed["first_id"])
    bodies = scratch.write(given.join(needed, same_row).select(given["key"], "text"), "texts")

    pairs = members.where(F.col("key") != F.col("hub"))
    pairs = pairs.select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    compared = scratch.write(compare(pairs, bodies, with_rest=True), "compared")
    links = compared.where(F.col("similarity") >= settings.least).select("a", "b")
    classes = components(links, scratch)

    distance = compared.select(
        F.col("a").alias("key"),
        F.col("b").alias("hub"),
        (1 - F.col("similarity")).alias("d"),
        F.col("left_size").alias("size"),
        "common",
        "rest",
    )
    own_hubs = True
    while True:
        placed = scratch.write(_placed(distance, classes), "placed")
        if placed.where("over").isEmpty():
            break
        rest = _LeftOver(placed, distance, settings, scratch)
        rows, pairs = rest.work()
        own_hubs = own_hubs and pairs > FEW_PAIRS * max(rows, 1)
        more = compare(rest.with_own_hubs() if own_hubs else rest.all(), bodies)
        more = scratch.write(more.where(F.col("similarity") >= settings.least).select("a", "b"), "more")
        links = links.unionByName(more)
        classes = components(links, scratch)
        scratch.drop(rest.found, placed)
        if not own_hubs:
            break
        own_hubs = more.count() * LEAST_GAIN >= rows
    scratch.drop(members, bodies)  # what follows reads none of them

    named = _with_class(texts.select("key", "first_id"), classes)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_text = named.join(smallest, "component").select("key", "class_id")
    rows = signed.select("id", "key").join(by_text, "key", "left")
    return rows.select(
        F.col("id").alias(id),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
    )
