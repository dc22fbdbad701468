"""Chinese restaurants in numpy: customers of many sections seated, moved and counted side by side.

A *section* is the part of a restaurant that serves one dish: ``c`` customers at ``t`` tables. Only
the sizes of its tables matter, so a section is a histogram: ``tables`` tables of ``size`` customers.
``Seats`` holds the histograms of many sections as rows sorted by (section, size); a section with a
billion customers is a few thousand rows. A new table is worth (strength + discount * tables of the
restaurant) * probability of the dish in the parent restaurant; ``Worth`` holds this for sections
as ``base`` + ``slope`` * their own tables, since the tables of the others stand still meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FRESH = 64  # a section that gains or loses more customers than this at once is seated anew
_DRAWINGS = 8  # seatings drawn for a large section, of which one is taken
_TABLED = 1024  # table sizes up to this are drawn from a list of their chances
_LARGEST = 1 << 50
_AT_ONCE = 1 << 20  # tables drawn together, in about; results do not depend on it


@dataclass
class Worth:
    base: np.ndarray
    slope: np.ndarray

    def of(self, sections: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return self.base[sections] + self.slope[sections] * tables


@dataclass
class Seats:
    section: np.ndarray
    size: np.ndarray
    tables: np.ndarray

    def table_counts(self, n: int) -> np.ndarray:
        return np.bincount(self.section, self.tables, n).astype(np.int64)

    def customers(self, n: int) -> np.ndarray:
        return np.bincount(self.section, self.size * self.tables, n).astype(np.int64)

    def where(self, rows: np.ndarray) -> Seats:
        return Seats(self.section[rows], self.size[rows], self.tables[rows])


def ordered(keys: np.ndarray) -> np.ndarray:
    """Places of the keys (none below zero) in their order, equal ones as they stand. Keys and places are
    sorted as one number where there is room, which takes a fraction of the time."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits < 63:
        return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)
    return np.argsort(keys, kind="stable")


def merged(*parts: Seats) -> Seats:
    """One sorted histogram of several; rows of equal section and size are added up."""
    section, size, tables = (
        np.concatenate([getattr(p, name) for p in parts]) for name in ("section", "size", "tables")
    )
    bits = int(size.max(initial=0)).bit_length()
    if int(section.max(initial=0)).bit_length() + bits < 63:
        order = ordered(section << bits | size)
    else:
        order = np.lexsort((size, section))
    section, size, tables = section[order], size[order], tables[order]
    if not len(section):
        return Seats(section, size, tables)
    first = np.ones(len(section), bool)
    first[1:] = (section[1:] != section[:-1]) | (size[1:] != size[:-1])
    starts = np.flatnonzero(first)
    tables = np.add.reduceat(tables, starts)
    some = (tables > 0) & (size[starts] > 0)
    return Seats(section[starts][some], size[starts][some], tables[some])


def _pick(seats: Seats, weights: np.ndarray, active: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One row of each active section, with probability in proportion to ``weights``."""
    start = np.searchsorted(seats.section, active, "left")
    end = np.searchsorted(seats.section, active, "right")
    total = np.append(0.0, np.cumsum(weights))
    at = total[start] + rng.random(len(active)) * (total[end] - total[start])
    return np.clip(np.searchsorted(total, at, "right") - 1, start, end - 1)


def _leave(seats: Seats, active: np.ndarray, rng: np.random.Generator) -> Seats:
    """One customer of each active section, any with equal chance, gets up."""
    row = _pick(seats, (seats.size * seats.tables).astype(float), active, rng)
    one = np.ones(len(row), np.int64)
    size = seats.size[row]
    return merged(seats, Seats(active, size, -one), Seats(active, size - 1, one))


def _enter(
    seats: Seats, active: np.ndarray, worth: Worth, discount: float, rng: np.random.Generator
) -> Seats:
    """One customer of each active section sits down, at a table taken or a new one."""
    one = np.ones(len(active), np.int64)
    places = np.searchsorted(seats.section, active)
    taken = np.zeros(len(active), bool)
    if len(seats.section):
        taken = seats.section[np.minimum(places, len(seats.section) - 1)] == active
    shares = (seats.size - discount) * seats.tables
    n = max(int(active.max()), int(seats.section.max(initial=0))) + 1
    old = np.bincount(seats.section, shares, n)[active]
    new = worth.of(active, np.bincount(seats.section, seats.tables, n)[active])
    joins = taken & (rng.random(len(active)) * (new + old) < old)
    row = _pick(seats, shares, active[joins], rng)
    new, size = active[~joins], seats.size[row]
    return merged(
        seats,
        Seats(active[joins], size, -one[joins]),
        Seats(active[joins], size + 1, one[joins]),
        Seats(new, one[~joins], one[~joins]),
    )


def seat(
    section: np.ndarray, customers: np.ndarray, worth: Worth, discount: float, rng: np.random.Generator
) -> Seats:
    """A first seating: the number of tables as if all came in one after the other (in growing
    groups that share one probability of a new table), the sizes in a plain shape."""
    tables, seen = np.minimum(customers, 1), np.minimum(customers, 1)
    live = np.flatnonzero(customers > seen)
    while len(live):
        group = np.minimum(np.maximum(seen[live] // 8, 1), customers[live] - seen[live])
        new = worth.of(live, tables[live])
        new = new / (new + seen[live] - discount * tables[live])
        tables[live] += rng.binomial(group, np.clip(new, 0, 1))
        seen[live] += group
        live = live[customers[live] > seen[live]]
    alone = np.where(tables < customers, np.minimum((discount * tables).astype(np.int64), tables - 1), 0)
    alone = np.maximum(alone, 0)
    rest, left = tables - alone, customers - alone
    size = left // np.maximum(rest, 1)
    larger = left - size * rest
    one = np.ones(len(section), np.int64)
    return merged(
        Seats(section, one, alone), Seats(section, size, rest - larger), Seats(section, size + 1, larger)
    )


def _move(
    seats: Seats, active: np.ndarray, worth: Worth, discount: float, rng: np.random.Generator
) -> Seats:
    """One customer of each active section gets up and sits down: at the table just left, at another
    one, or at a new one."""
    start = np.searchsorted(seats.section, active, "left")
    end = np.searchsorted(seats.section, active, "right")

    def pick(total: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(total, total[start] + at, "right") - 1, start, end - 1)

    total = np.append(0.0, np.cumsum(seats.size * seats.tables))
    left = pick(total, rng.random(len(active)) * (total[end] - total[start]))
    size, tables = seats.size[left], seats.tables.copy()
    tables[left] -= 1
    total = np.append(0.0, np.cumsum((seats.size - discount) * tables))
    other = total[end] - total[start]
    back = np.where(size > 1, size - 1 - discount, 0.0)
    count = np.append(0, np.cumsum(tables))
    new = worth.of(active, count[end] - count[start] + (size > 1))
    at = rng.random(len(active)) * (new + back + other)
    joined = pick(total, at - new - back)
    stays = (at >= new) & (at < new + back) | (at < new) & (size == 1) | (at >= new) & (tables[joined] == 0)
    opens, joins = (at < new) & ~stays, (at >= new) & ~stays
    gone, one = opens | joins, np.ones(len(active), np.int64)
    if not gone.any():
        return seats
    joined_size = seats.size[joined]
    return merged(
        seats,
        Seats(active[gone], size[gone], -one[gone]),
        Seats(active[gone], size[gone] - 1, one[gone]),
        Seats(active[opens], one[opens], one[opens]),
        Seats(active[joins], joined_size[joins], -one[joins]),
        Seats(active[joins], joined_size[joins] + 1, one[joins]),
    )


def gibbs(
    seats: Seats,
    customers: np.ndarray,
    worth: Worth,
    discount: float,
    moves: int,
    rng: np.random.Generator,
) -> Seats:
    """A Gibbs sweep: all customers move, given where those of the other sections sit. A section of at
    most ``moves`` customers makes as many single moves as it has customers; in a larger one all get
    up together but those of one table (see ``_reseat``). A customer alone in a section sits at one
    table whatever happens; two share one or not, wherever they sat before."""
    large, two = np.flatnonzero(customers > moves), np.flatnonzero(customers == 2)
    apart = (customers > moves)[seats.section]
    resting = [_reseat(seats.where(apart), customers, large, worth, discount, rng)] if len(large) else []
    new = worth.of(two, np.ones(len(two), np.int64))
    opens = rng.random(len(two)) * (new + 1 - discount) < new
    resting.append(Seats(two, np.where(opens, 1, 2), np.where(opens, 2, 1)))
    seats = seats.where(~apart & (customers != 2)[seats.section])
    for k in range(moves):
        active = (customers > max(k, 2)) & (customers <= moves)
        moving = active[seats.section]
        resting.append(seats.where(~moving))
        seats = seats.where(moving)
        sections = np.flatnonzero(active)
        if not len(sections):
            break
        seats = _move(seats, sections, worth, discount, rng)
    return merged(seats, *resting)


def _sibuya(n: int, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes with probability discount * (1 - discount) ... (size - 1 - discount) / size!: what a table
    of many is drawn from."""
    steps = np.arange(1, _TABLED + 1)
    more = np.append(1.0, np.cumprod((steps - discount) / steps))  # probability of more than 0, 1, ...
    size = np.searchsorted(-more, -rng.random(n)).astype(np.int64)
    far = np.flatnonzero(size > _TABLED)
    # Beyond, a size is geometric with a beta-distributed chance of ending.
    ends = rng.beta(discount, 1 - discount + _TABLED, len(far))
    with np.errstate(divide="ignore"):
        more = rng.exponential(size=len(far)) / -np.log1p(-ends)
    size[far] = _TABLED + 1 + np.minimum(more, float(_LARGEST)).astype(np.int64)
    return size


def _tilted(tilt: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A size for each element of ``tilt``, less likely by this factor with each customer."""
    size, todo = np.empty(len(tilt), np.int64), np.arange(len(tilt))
    while len(todo):
        drawn = _sibuya(len(todo), discount, rng)
        taken = rng.random(len(todo)) < tilt[todo] ** (drawn - 1)
        size[todo[taken]] = drawn[taken]
        todo = todo[~taken]
    return size


def _log_weight(size: np.ndarray, tilt: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of Gamma(size - discount) / Gamma(size) * tilt ** size, but for a constant."""
    steps = np.arange(1, _TABLED)
    tabled = np.append(0.0, np.cumsum(np.log((steps - discount) / steps)))  # of sizes 1, 2, ...
    middle = (discount + 1) / 2
    far = tabled[-1] - discount * np.log(np.maximum(size - middle, 1) / (_TABLED - middle))
    return np.where(size <= _TABLED, tabled[np.clip(size, 1, _TABLED) - 1], far) + size * np.log(tilt)


def _tilt(customers: np.ndarray, share: np.ndarray, tables: np.ndarray, discount: float) -> tuple:
    """For each section the tilt of the sizes with which a drawing has about its number of customers,
    and the chance of a further table. Any tilt is right; this one wastes few drawings."""
    low, high = np.full(len(customers), -40.0), np.log(8.0 * customers)
    for _ in range(16):
        x = (low + high) / 2
        tilt, rest = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(x))
        others = tables * share * discount * tilt * rest ** (discount - 1) / (1 - share + share * rest**discount)
        many = others + 1 + tilt * (1 - discount) / rest > customers
        low, high = np.where(many, low, x), np.where(many, x, high)
    return tilt, share * (1 - rest**discount)


def _reseat(
    seats: Seats,
    customers: np.ndarray,
    sections: np.ndarray,
    worth: Worth,
    discount: float,
    rng: np.random.Generator,
) -> Seats:
    """All customers of the sections but those of one table get up and are seated anew together.

    The table that stays is that of a customer picked at random. Seatings of all others are drawn
    ``_DRAWINGS`` times: their number of tables is negative binomial, their sizes are independent,
    and the table that stays takes who is left. Against the chances wanted such a drawing is off by a
    weight of that table's size alone; one of the drawings and the present seating is picked by
    these weights. This leaves the chances given all other sections as they are (a Gibbs move with
    particles), and its work grows with the number of tables, not of customers.
    """
    picked = _pick(seats, (seats.size * seats.tables).astype(float), sections, rng)
    total, share = customers[sections], worth.slope[sections] / discount
    tables = worth.base[sections] / worth.slope[sections] + 1
    tilt, further = _tilt(total, share, tables, discount)
    further = np.minimum(further, 1 - 1e-12)
    load = np.minimum(tables * further / (1 - further), total) + 1
    piece = (np.cumsum(load) * _DRAWINGS // _AT_ONCE).astype(np.int64)
    borders = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    parts, anew = [], np.zeros(len(customers), bool)
    for a, b in zip(borders, np.append(borders[1:], len(piece))):
        n = b - a
        m = rng.negative_binomial(tables[a:b], 1 - further[a:b], (_DRAWINGS, n))
        fits = m < total[a:b]
        owner = np.repeat(np.arange(_DRAWINGS * n), np.where(fits, m, 0).ravel())
        size = _tilted(tilt[a:b][owner % n], discount, rng)
        left = total[a:b] - np.bincount(owner, size, _DRAWINGS * n).reshape(-1, n)
        stays = np.concatenate([np.maximum(left, 1), seats.size[picked[a:b]][None]]).astype(np.int64)
        weight = _log_weight(stays, tilt[a:b], discount)
        weight[:-1][~fits | (left < 1)] = -np.inf
        best = np.argmax(weight + rng.gumbel(size=weight.shape), axis=0)
        mine = best[owner % n] == owner // n
        fresh = np.flatnonzero(best < _DRAWINGS)
        anew[sections[a:b][fresh]] = True
        section = np.append(sections[a:b][owner[mine] % n], sections[a:b][fresh])
        size = np.append(size[mine], stays[best[fresh], fresh])
        parts.append(merged(Seats(section, size, np.ones(len(size), np.int64))))
    return merged(seats.where(~anew[seats.section]), *parts)


def adjusted(
    seats: Seats, customers: np.ndarray, worth: Worth, discount: float, rng: np.random.Generator
) -> Seats:
    """Seats of sections whose numbers of customers have become ``customers``: some get up or sit
    down; sections that change much are seated anew."""
    now = seats.customers(len(customers))
    anew = np.abs(now - customers) > _FRESH
    if anew.any():
        places = np.flatnonzero(anew)
        part = Worth(worth.base[places], worth.slope[places])
        fresh = seat(places, customers[places], part, discount, rng)
        seats = merged(seats.where(~anew[seats.section]), fresh)
        now = np.where(anew, customers, now)
    resting = []
    while len(places := np.flatnonzero(now != customers)):
        moving = (now != customers)[seats.section]
        resting.append(seats.where(~moving))
        seats = seats.where(moving)
        leaves = places[now[places] > customers[places]]
        enters = places[now[places] < customers[places]]
        if len(leaves):
            seats = _leave(seats, leaves, rng)
            now[leaves] -= 1
        if len(enters):
            seats = _enter(seats, enters, worth, discount, rng)
            now[enters] += 1
    return merged(seats, *resting)
