"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``.

Turns are kept, given another role, deleted or inserted; blank and repeated turns must be deleted,
truncated ones cost more if they stay. The costs are solved by Four-Russians block tables
(``edit_blocks``): turns become symbols, blocks of four symbols are looked up, and blocks are expanded
backward to trace the edits, ties to the least string.

*Long conversations.* The rows of a conversation, in order, are cut into *nodes* of at most
``NODE`` rows; a row's global place gives its node. What a node makes of every cost vector, and of
every state, is a small table, and such tables can be composed. Conversations of several nodes are
solved over a tree of nodes (``_scan``), so one with a third of all turns is spread like many
small ones. Only the last step of the registered query, the hash of a whole conversation, reads one
conversation in sequence; it streams and holds a digest, not the text.

Order and nulls: rows are taken by turn, null turns first, then by role and MD5 of the text;
identical rows are interchangeable. Null roles and texts read as one space, so a null text is blank.
All rows with a null conversation are one conversation. Repeated rows are duplicates, deleted but
for the first. A role counts by its first character; an empty role has none and is no legal one.
Long texts are read whole. Other columns are ignored, clashing names included. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm import edit_blocks
from threadlake.scratch import Scratch

NODE_BITS = 12
NODE = 1 << NODE_BITS
LEGAL = ("su", "ua", "au")
_BLANKS = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with planted faults, chosen by a CRC of the place."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    action = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("_action") == 1, "").when(
        F.col("_action") == 2, F.regexp_replace("text", "[.!?]", "")
    )
    return (
        turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), action.alias("_action"))
        .where("_action <> 0")
        .withColumn("_copy", F.explode(F.when(F.col("_action") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_action") == 4, "user").otherwise(F.col("role")).alias("role"),
            text.otherwise(F.col("text")).alias("text"),
        )
    )


def _key(name: str) -> Column:
    """A conversation's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def place_rows(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv, turn, role, text, place), placed in order; written, as places must not change.

    Range partitions split a conversation, so that none is one task's. The last key only splits
    identical rows.
    """
    rows = turns.select(
        _key("conv_id").alias("conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = ["conv", "turn", "role", "_text", "_row"]
    rows = rows.withColumn("_text", F.md5(F.col("text").cast("binary"))).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.write(rows.withColumn("place", F.monotonically_increasing_id()).drop("_row"), "placed")


def with_faults(placed: DataFrame) -> DataFrame:
    """Narrow rows (conv, node, place, turn, initial, fault, symbol); no text."""
    last = F.rtrim("text", F.lit(_BLANKS)).substr(F.lit(-1), F.lit(1))
    narrow = placed.select(
        "conv",
        F.shiftright("place", NODE_BITS).alias("node"),
        "place",
        "turn",
        "role",
        "_text",
        F.col("role").substr(1, 1).alias("initial"),
        last.alias("_last"),
    )
    firsts = narrow.groupBy("conv", "role", "_text").agg(F.min("place").alias("place"))
    firsts = firsts.select("place", F.lit(True).alias("_first"))
    fault = (
        F.when(F.col("_last") == "", "blank")
        .when(F.col("_first").isNull(), "duplicate")
        .when(~F.col("_last").isin(".", "!", "?"), "truncated")
    )
    role = F.instr(F.lit(edit_blocks.INITIALS), F.col("initial")) - 1
    role = F.when((F.col("initial") != "") & (role >= 0), role).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), edit_blocks.TO_DELETE).otherwise(
        role + F.when(F.col("fault") == "truncated", 4).otherwise(0)
    )
    return (
        narrow.join(firsts, "place", "left")
        .withColumn("fault", fault)
        .select("conv", "node", "place", "turn", "initial", "fault", symbol.cast("int").alias("symbol"))
    )


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Sorted batches cut where (conv, node) changes: tables, and starts and lengths of their runs."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
        if held is None or not held.num_rows:
            continue
        changed = np.zeros(held.num_rows, bool)
        changed[0] = True
        for name in ("conv", "node"):
            column = held.column(name).combine_chunks()
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            changed[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(changed)
        end = held.num_rows if batch is None else int(starts[-1])
        starts = starts[starts < end]
        if len(starts):
            yield held.slice(0, end), starts, np.diff(np.append(starts, end))
        held = held.slice(end).combine_chunks()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _classes(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of like length (within a factor of two), so that filling them up costs little."""
    size = np.ceil(np.log2(lengths)).astype(int)
    for value in np.unique(size):
        yield np.flatnonzero(size == value)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _per_node(rows: DataFrame, function: Callable, schema: str, *columns: str) -> DataFrame:
    """Run ``function`` over partitions that hold whole nodes, in order."""
    sent = rows.select("conv", "node", "place", "symbol", *columns)
    sent = sent.repartition("conv", "node").sortWithinPartitions("conv", "node", "place")
    return sent.mapInArrow(function, schema)


def _vector_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each node makes of every cost vector on its right."""
    vectors = np.arange(len(edit_blocks.tables().one), dtype=np.int16)
    for table, starts, lengths in _whole_runs(batches):
        symbols, made = _numbers(table, "symbol"), np.empty((len(starts), len(vectors)), np.int16)
        for runs in _classes(lengths):
            rows = edit_blocks.aligned(symbols, starts[runs], lengths[runs])
            made[runs] = edit_blocks.backward(rows, np.tile(vectors, (len(runs), 1)))[0]
        yield _maps(table, starts, made)


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each node makes of every state on its left, its right vector being known."""
    states = np.arange(edit_blocks.STATES, dtype=np.int8)
    for table, starts, lengths in _whole_runs(batches):
        symbols, made = _numbers(table, "symbol"), np.empty((len(starts), len(states)), np.int16)
        right = _numbers(table, "right")[starts]
        for runs in _classes(lengths):
            rows = edit_blocks.aligned(symbols, starts[runs], lengths[runs])
            behind = edit_blocks.expand(rows, edit_blocks.backward(rows, right[runs])[1])
            made[runs] = edit_blocks.forward(rows, behind, np.tile(states, (len(runs), 1)))[0]
        yield _maps(table, starts, made)


def _maps(table: pa.Table, starts: np.ndarray, made: np.ndarray) -> pa.RecordBatch:
    heads = table.select(["conv", "node"]).take(starts).combine_chunks()
    ends = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
    arrays = [heads.column(i).combine_chunks() for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*arrays, lists], names=["conv", "node", "map"])


_MAP = "conv string, node bigint, map array<smallint>"


def _scan(nodes: DataFrame, scratch: Scratch, given: int, from_right: bool) -> DataFrame:
    """(conv, node, value): what reaches each node of its conversation from one side.

    ``nodes`` (conv, node, map) say what a node makes of every value that reaches it; ``given`` is
    what reaches the outermost one. Up to ``NODE`` neighbours are composed to one node of the level
    above, by the leading bits of their number, until conversations have one node each.
    """
    several = nodes.groupBy("conv").count().where("count > 1")
    if several.isEmpty():
        return nodes.select("conv", "node", F.lit(given).alias("value"))
    group = nodes.withColumn("parent", F.shiftright("node", NODE_BITS))

    def ordered(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, reverse=from_right)

    def compose(key: tuple, children: pa.Table) -> pa.Table:
        rows = ordered(list(zip(children["node"].to_pylist(), children["map"].to_pylist())))
        made = np.arange(len(rows[0][1]))
        for _, one in rows:
            made = np.asarray(one)[made]
        columns = [pa.array([x.as_py()]) for x in key] + [pa.array([made.tolist()], pa.list_(pa.int16()))]
        return pa.table(columns, names=["conv", "node", "map"])

    parents = group.groupBy("conv", "parent").applyInArrow(compose, _MAP)
    above = _scan(scratch.write(parents, "nodes"), scratch, given, from_right)
    below = group.join(above.select("conv", F.col("node").alias("parent"), "value"), ["conv", "parent"])

    def hand_down(key: tuple, children: pa.Table) -> pa.Table:
        rows = ordered(list(zip(*(children[c].to_pylist() for c in ("node", "map", "value")))))
        value, out = rows[0][2], []
        for node, one, _ in rows:
            out.append((node, value))
            value = one[value]
        columns = [pa.array([key[0].as_py()] * len(out)), *(pa.array(c) for c in zip(*out))]
        return pa.table(columns, schema=pa.schema([("conv", pa.string()), ("node", pa.int64()), ("value", pa.int32())]))

    handed = below.groupBy("conv", "parent").applyInArrow(hand_down, "conv string, node bigint, value int")
    return scratch.write(handed, "values")


_EDITED = (
    "place bigint, edits string, inserted array<string>, new_role string, closing array<string>"
)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of every row; the last row of a conversation also has the roles that close it."""
    t = edit_blocks.tables()
    edits = pa.array([s.edits for s in t.steps], pa.string())
    inserted = pa.array([list(s.inserted) for s in t.steps], pa.list_(pa.string()))
    roles = pa.array([s.role for s in t.steps], pa.string())
    closing = pa.array([*map(list, t.closing), []], pa.list_(pa.string()))
    for table, starts, lengths in _whole_runs(batches):
        symbols, step = _numbers(table, "symbol"), np.zeros(table.num_rows, np.int64)
        right, left = _numbers(table, "right")[starts], _numbers(table, "left")[starts]
        closes = _numbers(table, "is_last")[starts].astype(bool)
        close = np.full(table.num_rows, len(t.closing), np.int64)
        for runs in _classes(lengths):
            rows = edit_blocks.aligned(symbols, starts[runs], lengths[runs])
            behind = edit_blocks.expand(rows, edit_blocks.backward(rows, right[runs])[1])
            state, steps = edit_blocks.forward(rows, behind, left[runs])
            real = np.arange(rows.shape[1]) >= rows.shape[1] - lengths[runs][:, None]
            places = np.repeat(starts[runs], lengths[runs]) + np.concatenate([np.arange(n) for n in lengths[runs]])
            step[places] = steps.T[real]
            ending = runs[closes[runs]]
            close[starts[ending] + lengths[ending] - 1] = state[closes[runs]]
        columns = [table.column("place").combine_chunks()]
        columns += [values.take(pa.array(step)) for values in (edits, inserted, roles)]
        columns.append(closing.take(pa.array(close)))
        yield pa.RecordBatch.from_arrays(columns, names=["place", "edits", "inserted", "new_role", "closing"])


def repair(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Faults and edits of the rows of ``turns`` (conv_id, turn, role, text).

    The first table has conv, place, turn, role, text, fault and illegal (the role may not follow the
    one before) of each row, ``edits`` (initials in order: insertions before the row, then its own),
    ``new_role`` if it gets one, and ``lines``: the repaired ``role:text`` lines it gives. The second
    one is the first without its texts and lines.
    """
    placed = place_rows(turns, scratch)
    rows = scratch.write(with_faults(placed), "faults")
    nodes = rows.groupBy("conv", "node").agg(F.max_by("initial", "place").alias("_last"))
    nodes = scratch.write(nodes, "nodes")
    counts = nodes.groupBy("conv").agg(F.count("*").alias("n"), F.max("node").alias("_end"))
    many = counts.where("n > 1").select("conv", "_end")
    long = scratch.write(rows.join(many.select("conv"), "conv", "left_semi"), "long")

    # Conversations of several nodes: what reaches each node from either side.
    end = edit_blocks.tables().end
    right = _scan(scratch.write(_per_node(long, _vector_maps, _MAP), "maps"), scratch, end, True)
    right = right.select("conv", "node", F.col("value").alias("right"))
    known = long.join(right, ["conv", "node"])
    states = scratch.write(_per_node(known, _state_maps, _MAP, "right"), "maps")
    left = _scan(states, scratch, edit_blocks.START, False)
    left = left.select("conv", "node", F.col("value").alias("left"))
    by_place = Window.partitionBy("conv").orderBy("node")
    between = (
        nodes.join(many, "conv")
        .withColumn("before", F.lag("_last").over(by_place))
        .withColumn("is_last", (F.col("node") == F.col("_end")).cast("int"))
        .drop("_last", "_end")
        .join(right, ["conv", "node"])
        .join(left, ["conv", "node"])
    )

    # All others are one node, with nothing on either side.
    in_node = Window.partitionBy("conv", "node").orderBy("place")
    pair = F.concat(F.coalesce(F.lag("initial").over(in_node), "before"), "initial")
    complete = scratch.write(
        rows.join(between, ["conv", "node"], "left").select(
            *rows.columns,
            F.coalesce("right", F.lit(end)).alias("right"),
            F.coalesce("left", F.lit(edit_blocks.START)).alias("left"),
            F.coalesce("is_last", F.lit(1)).alias("is_last"),
            F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"),
        ),
        "complete",
    )
    edited = scratch.write(_per_node(complete, _trace, _EDITED, "right", "left", "is_last"), "edits")
    narrow = complete.select("conv", "place", "turn", "fault", "illegal").join(
        edited.select("place", "edits", "new_role", "closing"), "place"
    )
    closed = F.when(F.size("closing") > 0, F.concat("edits", F.repeat(F.lit("I"), F.size("closing"))))
    closed = F.coalesce(closed, "edits")
    own = F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text")
    lines = F.concat(
        F.transform("inserted", lambda r: F.concat(r, F.lit(":"))),
        F.when(F.col("_own") == "D", F.array().cast("array<string>")).otherwise(F.array(own)),
        F.transform("closing", lambda r: F.concat(r, F.lit(":"))),
    )
    full = (
        placed.select("conv", "place", "turn", "role", "text")
        .join(complete.select("place", "fault", "illegal"), "place")
        .join(edited, "place")
        .withColumn("_own", F.substring("edits", -1, 1))
        .withColumn("lines", lines)
        .withColumn("edits", closed)
        .drop("_own", "inserted", "closing")
    )
    return full, narrow.withColumn("edits", closed).drop("closing")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation, streamed from its rows in order."""

    def ended(done: list[tuple]) -> pa.RecordBatch:
        names = ("conv", "audit", "repaired_sha256")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=names)

    conv, audit, sha, some = None, [], None, False
    for batch in batches:
        done = []
        for name, edits, lines in zip(*(batch.column(i) for i in range(3))):
            if (name := name.as_py()) != conv:
                if conv is not None:
                    done.append((conv, "".join(audit), sha.hexdigest()))
                conv, audit, sha, some = name, [], hashlib.sha256(), False
            audit.append(edits.as_py())
            for line in lines:
                if some:
                    sha.update(b"\n")
                sha.update(line.as_buffer())
                some = True
        if done:
            yield ended(done)
    if conv is not None:
        yield ended([(conv, "".join(audit), sha.hexdigest())])


def digest(full: DataFrame, narrow: DataFrame, original: DataFrame) -> DataFrame:
    """One row for each conversation of ``original``, with counts, cost, edits and hash."""

    def letters(of: str) -> Column:
        return F.length("edits") - F.length(F.replace("edits", F.lit(of), F.lit("")))

    stays = ~F.contains("edits", F.lit("D")) & (F.col("fault") == "truncated")
    cost = (
        edit_blocks.INSERT * letters("I")
        + edit_blocks.REROLE * letters("R")
        + edit_blocks.DELETE * letters("D")
        + F.when(stays, edit_blocks.TRUNCATED).otherwise(0)
    )
    faults = ("blank", "duplicate", "truncated")
    by_turn = narrow.groupBy("conv", "turn").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in faults],
        F.count_if("illegal").alias("illegal"),
        F.sum(cost).alias("cost"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    numbers = by_turn.groupBy("conv").agg(
        gaps.alias("gaps"), *[F.sum(c).alias(c) for c in (*faults, "illegal", "cost")]
    )
    stream = full.select("conv", "edits", "lines", "place")
    stream = stream.repartition("conv").sortWithinPartitions("conv", "place").drop("place")
    texts = stream.mapInArrow(_digests, "conv string, audit string, repaired_sha256 string")
    asked = original.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
    counts = ["gaps", *faults, "illegal", "cost"]
    return (
        asked.join(numbers, "conv", "left")
        .join(texts, "conv", "left")
        .select(
            "conv_id",
            *[F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
