"""Four-Russians tables for the cheapest edits of a row of symbols under a small automaton.

A *cost vector* holds, for each state, the cheapest cost of all that is still to come. Going
backward over one symbol makes a new vector of it. Vectors that differ by a constant have the same
edits, so they are normalised to a least entry of 0; then only a few dozen different ones exist,
and each gets a number. A block of ``BLOCK`` symbols is a number too, so that a table answers what
a whole block makes of a vector, in one lookup.

Ties: going forward, a row takes the first of Delete, Insert, Keep, Rerole (their initials in ASCII
order) that is still cheapest. An insertion is never free, so this gives the least string. It needs
the vector behind every symbol: blocks are expanded backward from the vector at their right end.
"""

from __future__ import annotations

from functools import cache
from itertools import product
from typing import NamedTuple

import numpy as np

# States, the roles allowed from each, and the costs of edits.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = 4
KEPT = {
    (START, "s"): AFTER_SYSTEM,
    (START, "u"): AFTER_USER,
    (AFTER_SYSTEM, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT,
    (AFTER_ASSISTANT, "u"): AFTER_USER,
}
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)  # the role to insert or to give
NEXT_ROLE = ("user", "user", "assistant", "user")
ACCEPTED = (START, AFTER_ASSISTANT)
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3

# Symbols: initial s, u, a or another one; the same for truncated rows; rows to delete; nothing.
INITIALS = "sua"
SYMBOLS = 10
TO_DELETE, NOTHING = 8, 9
BLOCK = 4

_FAR = 1 << 20


class Step(NamedTuple):
    """What happens from the end of one row to the end of the next: its edits in order, the roles
    inserted before it, and its new role if it gets one."""

    edits: str
    inserted: tuple[str, ...]
    role: str | None


class Tables(NamedTuple):
    end: int  # the vector behind the last symbol
    one: np.ndarray  # vector, symbol -> vector
    block: np.ndarray  # vector, block number -> vector
    state: np.ndarray  # vector on the right, symbol, state -> state
    step: np.ndarray  # vector on the right, symbol, state -> place in ``steps``
    steps: list[Step]
    closing: list[tuple[str, ...]]  # roles inserted at the end, by state


def _with_insertions(costs: list[int]) -> tuple[int, ...]:
    costs = list(costs)
    for _ in range(STATES):
        for state in range(STATES):
            costs[state] = min(costs[state], INSERT + costs[NEXT[state]])
    return tuple(costs)


def _choices(behind: tuple[int, ...], symbol: int, state: int) -> list[tuple[int, str, int]]:
    """(cost with all that follows, edit, state) of every way to take one row."""
    ways = [(DELETE + behind[state], "D", state)]
    if symbol != TO_DELETE:
        more = TRUNCATED * (symbol >= 4)
        kept = KEPT.get((state, INITIALS[symbol % 4])) if symbol % 4 < 3 else None
        if kept is not None:
            ways.append((more + behind[kept], "K", kept))
        ways.append((more + REROLE + behind[NEXT[state]], "R", NEXT[state]))
    return ways


def _before(behind: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    if symbol == NOTHING:
        return behind
    return _with_insertions([min(_choices(behind, symbol, q))[0] for q in range(STATES)])


def _step(behind: tuple[int, ...], symbol: int, state: int) -> tuple[Step, int]:
    if symbol == NOTHING:
        return Step("", (), None), state
    here, edits, inserted = _before(behind, symbol), "", []
    while True:
        ways = {edit: (cost, to) for cost, edit, to in _choices(behind, symbol, state)}
        ways["I"] = (INSERT + here[NEXT[state]], NEXT[state])
        edit = min(e for e, (cost, _) in ways.items() if cost == here[state])
        edits += edit
        if edit != "I":
            role = NEXT_ROLE[state] if edit == "R" else None
            return Step(edits, tuple(inserted), role), ways[edit][1]
        inserted.append(NEXT_ROLE[state])
        state = NEXT[state]


def _closing(state: int) -> tuple[str, ...]:
    roles = []
    while state not in ACCEPTED:
        roles.append(NEXT_ROLE[state])
        state = NEXT[state]
    return tuple(roles)


def _normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(c - min(costs) for c in costs)


@cache
def tables() -> Tables:
    end = _normal(_with_insertions([0 if q in ACCEPTED else _FAR for q in range(STATES)]))
    numbers, vectors, one = {end: 0}, [end], []
    for vector in vectors:  # grows while new vectors turn up
        row = []
        for symbol in range(SYMBOLS):
            new = _normal(_before(vector, symbol))
            if new not in numbers:
                numbers[new] = len(vectors)
                vectors.append(new)
            row.append(numbers[new])
        one.append(row)
    one = np.array(one, np.int16)
    block = one
    for _ in range(BLOCK - 1):  # one more symbol on the left of every block
        block = one[block].transpose(0, 2, 1).reshape(len(vectors), -1)

    steps, places = [], {}
    state = np.zeros((len(vectors), SYMBOLS, STATES), np.int8)
    step = np.zeros(state.shape, np.int16)
    for (v, vector), symbol, q in product(enumerate(vectors), range(SYMBOLS), range(STATES)):
        made, state[v, symbol, q] = _step(vector, symbol, q)
        if made not in places:
            places[made] = len(steps)
            steps.append(made)
        step[v, symbol, q] = places[made]
    closing = [_closing(q) for q in range(STATES)]
    return Tables(0, one, block, state, step, steps, closing)


def aligned(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of symbols, one per run, filled up on the left to whole blocks."""
    width = -(-int(lengths.max()) // BLOCK) * BLOCK
    out = np.full((len(starts), width), NOTHING, np.int8)
    run = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[run, place + np.repeat(width - lengths, lengths)] = symbols[np.repeat(starts, lengths) + place]
    return out


def _block_numbers(rows: np.ndarray) -> np.ndarray:
    digits = rows.reshape(len(rows), -1, BLOCK).astype(np.int32)
    return digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def backward(rows: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors on the left of each row, and on the right of each of its blocks. ``right`` has one
    vector per row, or several to be followed side by side."""
    t, blocks = tables(), _block_numbers(rows)
    edges = np.empty((blocks.shape[1], *right.shape), np.int16)
    now = right
    for j in range(blocks.shape[1] - 1, -1, -1):
        edges[j] = now
        now = t.block[now, blocks[:, j].reshape(-1, *[1] * (right.ndim - 1))]
    return now, edges


def expand(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The vector on the right of every symbol, from those on the right of the blocks."""
    t = tables()
    symbols = rows.reshape(len(rows), -1, BLOCK)
    out = np.empty(symbols.shape, np.int16)
    now = edges.T
    for k in range(BLOCK - 1, -1, -1):
        out[:, :, k] = now
        now = t.one[now, symbols[:, :, k]]
    return out.reshape(rows.shape)


def forward(rows: np.ndarray, behind: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at the end of each row, and the step of every symbol. ``state`` has one state per row,
    or several to be followed side by side."""
    t = tables()
    steps = np.empty((rows.shape[1], *state.shape), np.int16)
    more = [1] * (state.ndim - 1)
    for i in range(rows.shape[1]):
        at = behind[:, i].reshape(-1, *more), rows[:, i].reshape(-1, *more), state
        steps[i] = t.step[at]
        state = t.state[at]
    return state, steps
