import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from threadlake.llm import edit_blocks, turn_repair
from threadlake.scratch import Scratch

TURNS = "conv_id bigint, turn bigint, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        action = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if action == 1:
            text = ""
        if action == 2:
            text = re.sub("[.!?]", "", text)
        if action == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(action, 1)
    return out


def plain_repair(rows):
    """Faults, and the cheapest and least edits by a table over all suffixes."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {q: (0, "", ()) if q in ("", "a") else None for q in "|s|u|a".split("|")}
    best["u"] = (3, "I", ("assistant:",))
    best["s"] = (6, "II", ("user:", "assistant:"))
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults)):
        more = 3 if fault == "truncated" else 0

        def ways(q):
            yield 4 + best[q][0], "D" + best[q][1], best[q][2]
            if fault in ("blank", "duplicate"):
                return
            to = after.get((q, role[:1]))
            if to:
                yield more + best[to][0], "K" + best[to][1], (f"{role}:{text}", *best[to][2])
            name = "assistant" if q == "u" else "user"
            rest = best[name[0]]
            yield more + 3 + rest[0], "R" + rest[1], (f"{name}:{text}", *rest[2])

        here = {q: list(ways(q)) for q in best}
        for _ in range(4):
            for q in best:
                name = "assistant" if q == "u" else "user"
                cost, edits, lines = min(here[name[0]])
                here[q].append((3 + cost, "I" + edits, (f"{name}:", *lines)))
        best = {q: min(here[q]) for q in best}
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        best[""][0],
        best[""][1],
        hashlib.sha256("\n".join(best[""][2]).encode()).hexdigest(),
    )


def check(spark, rows, damaged=False):
    """The digest of ``rows`` against the plain version."""
    given = spark.createDataFrame(rows, TURNS)
    damage = turn_repair.damage(given) if damaged else given
    found = turn_repair.digest(*turn_repair.repair(damage, Scratch(spark, "test")), given)
    found = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    by_conv = defaultdict(list)
    for row in plain_damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by_conv[row[0]].append(row)
    assert set(found) == {r[0] for r in rows}
    for conv, result in found.items():
        assert result == plain_repair(by_conv[conv]), conv


def made_rows(seed, convs, turns):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["Hi.", "no end", "", " \t", None, "Ja! \n", "again?", "x" * 3]
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randrange(1, turns)):
            role = rnd.choice(roles) if rnd.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rnd.choice(texts) if rnd.random() < 0.5 else f"Number {rnd.random()}."
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 2, None]), role, text))
    return rows


def test_random_conversations(spark):
    rows = made_rows(1, 150, 9)
    check(spark, rows)
    check(spark, rows + rows[:50], damaged=True)


def test_long_conversations_over_several_levels_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "NODE_BITS", 2)
    rows = [(0, t, r, x) for t, (_, _, r, x) in enumerate(made_rows(2, 40, 9))]
    rows += [(1, t, r, x) for t, (_, _, r, x) in enumerate(made_rows(3, 4, 9))]
    rows += [(None, t, r, x) for t, (_, _, r, x) in enumerate(made_rows(4, 3, 9))]
    check(spark, rows + [(5, 0, "user", "A."), (5, 1, "assistant", "B.")])


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "A."),
        (1, 0, "assistant", "B."),
        (2, 0, None, None),
        (None, None, None, None),
        (3, 0, "user", "long text " * 50_000 + "."),
        (3, 1, "assistant", "x" * 300_000),
        *[(4, 7, "user", "Same.")] * 5,
        (6, 0, "system", "Only."),
    ]
    check(spark, rows)
    check(spark, rows, damaged=True)


def test_a_conversation_without_rows_and_an_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "A."), (-1, 3, "user", "B.")], damaged=True)
    empty = spark.createDataFrame([], TURNS)
    repaired = turn_repair.repair(empty, Scratch(spark, "test"))
    assert turn_repair.digest(*repaired, empty).collect() == []


def test_repaired_rows_and_clashing_names(spark):
    rows = [(1, 0, "user", "A.", "x", 1), (1, 1, "user", "B.", "y", 2)]
    given = spark.createDataFrame(rows, TURNS + ", place string, conv int")
    full, _ = turn_repair.repair(given, Scratch(spark, "test"))
    found = [(r.edits, r.new_role, r.fault, r.illegal, r.lines) for r in full.orderBy("place").collect()]
    assert found == [("K", None, None, False, ["user:A."]), ("R", "assistant", None, True, ["assistant:B."])]


@pytest.mark.parametrize("length", [1, 3, 4, 5, 17])
def test_blocks_equal_single_steps(length):
    t, rnd = edit_blocks.tables(), random.Random(length)
    symbols = [rnd.randrange(9) for _ in range(length)]
    import numpy as np

    rows = edit_blocks.aligned(np.array(symbols, np.int8), np.array([0]), np.array([length]))
    left, edges = edit_blocks.backward(rows, np.array([t.end], np.int16))
    now, behind = t.end, []
    for s in reversed(symbols):
        behind.append(now)
        now = t.one[now, s]
    assert left[0] == now
    assert list(edit_blocks.expand(rows, edges)[0][-length:]) == behind[::-1]
