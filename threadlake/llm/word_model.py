"""Language-model scores by a hierarchical Pitman-Yor model of words, fitted by Gibbs sampling.

*Restaurants.* The dish is a word (or the end of a text). Its restaurant is the ending of the word
before it: the last two bytes, none at the start. The parent restaurant goes by the last byte alone,
its parent by nothing, and beyond that all V + 1 words (the training words and one for all others)
are equally likely. So there are at most 65,536 + 256 + 1 restaurants, however large the corpus, and
endings that end alike share what they have learnt. Each table of a restaurant is a customer of its
parent. With ``Settings.whole`` each whole word before has a restaurant of its own, whose parent is that
of its ending; tables of these are not gathered, but summed up at the homes of the words before.

*Fit.* All customers of one word, in all restaurants, lie in one *bucket* of words, picked by the
word's hash. In a sweep each bucket is one row that is worked on alone: the customers of every
(restaurant, word) get up and sit down again by the Chinese-restaurant rule, then those of the
parents; up to ``moves`` customers one by one, more of them together. Restaurants are tied together across buckets by their numbers of tables and customers only;
these come from the sweep before (so words of different buckets move at the same time) and are the
one thing that is gathered, bounded as above. Discounts follow from how many sections have one and
two customers.

*Scores.* The last ``samples`` sweeps are kept; a word's probability is the mean of its predictive
probabilities in them, a text's score the sum of their logarithms. Tokens are counted per chunk of
documents and sent to their word's bucket, from where sums per document come back. Words so frequent
that they would make a bucket hot are scored where they stand instead, by a table of at most
``here`` (word, restaurant) pairs that every task gets.

Words are told apart by a 64-bit hash: among a billion different ones, two share theirs with a
probability of about 0.03, and are then counted as one.

Results: one row per row of the input: ``id``, ``held_out`` (it was not learnt from), ``n_tokens``,
``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams), ``score``. A null or empty text has
one token, its end. With nothing to learn from, V is 0 and all scores are 0. Equal texts get equal
scores; repeated rows each count, in learning too. A null in ``learns`` is no. Texts are read whole,
very long ones as a chunk of their own. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadlake.llm.frames import text_of
from threadlake.llm.seating import Seats, Worth, adjusted, gibbs, merged, ordered, seat
from threadlake.scratch import Scratch

ENDINGS, LETTERS = 1 << 16, 1 << 8
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # a blank is no word


@dataclass(frozen=True)
class Settings:
    sweeps: int = 3
    samples: int = 2
    moves: int = 8
    strength: float = 1.0
    seed: int = 11
    chunk_bytes: int = 1 << 22
    bucket_bytes: int = 1 << 22
    here: int = 8 * ENDINGS
    whole: bool = False  # restaurants of whole words stand above those of endings


@dataclass
class Chunk:
    """Tokens of some documents, by word and restaurant: ``pair_word`` and ``pair_ending`` of each
    different pair, and for each pair its tokens' documents, from ``pair_start`` on in ``docs``. With
    whole words before, pairs differ by ``pair_context`` too: 48 bits of that word's hash, then its ending."""

    words: np.ndarray
    pair_word: np.ndarray
    pair_ending: np.ndarray
    pair_context: np.ndarray
    pair_start: np.ndarray
    docs: np.ndarray
    n_tokens: np.ndarray


def read_tokens(texts: pa.Array, whole: bool = False) -> Chunk:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found, n = lists.flatten(), np.array(pc.list_value_length(lists), np.int32)
    del lists
    real = pc.greater(pc.binary_length(found), 0)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)[real.to_numpy(zero_copy_only=False)]
    coded = found.filter(real).dictionary_encode()
    del found, real
    distinct = coded.dictionary.cast(pa.binary())
    hashes = map(xxhash.xxh3_64_intdigest, distinct.to_numpy(zero_copy_only=False))
    hashes = np.fromiter(hashes, np.uint64, len(distinct))
    ending = np.zeros(len(distinct) + 1, np.int64)
    if len(distinct):
        ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4)
        size = np.diff(ends)
        letters = np.frombuffer(distinct.buffers()[2], np.uint8).astype(np.int64)
        second = np.where(size > 1, letters[ends[1:] - np.minimum(size, 2)], 0)
        ending[:-1] = letters[ends[1:] - 1] * LETTERS + second

    # The end of each text goes behind its words; what follows an end has no word before it.
    n_tokens = np.bincount(doc, minlength=len(texts)) + 1
    tokens = np.full(int(n_tokens.sum()), len(distinct), np.int32)
    tokens[np.arange(len(doc), dtype=np.int32) + doc] = coded.indices.to_numpy()
    del doc, coded
    words, rank = np.unique(np.append(hashes, END), return_inverse=True)
    before = np.full(len(tokens), len(distinct), np.int32)
    before[1:] = tokens[:-1]
    width = len(distinct) + 1 if whole else ENDINGS
    key = rank[tokens] * width
    key += before if whole else ending[before]
    del before
    order = ordered(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), n_tokens)[order]
    present, place = np.unique(key[start] // width, return_inverse=True)
    last = key[start] % width
    contexts = np.append(hashes & ~np.uint64(ENDINGS - 1), np.uint64(0)) | ending.astype(np.uint64)
    context = contexts[last] if whole else np.empty(0, np.uint64)
    return Chunk(words[present], place, ending[last] if whole else last, context, start, docs, n_tokens)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted words have sorted buckets."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _lists(values: np.ndarray, borders: np.ndarray, type: pa.DataType) -> pa.ListArray:
    """One list per pair of neighbouring borders."""
    return pa.ListArray.from_arrays(
        pa.array(borders - borders[0], pa.int32()), pa.array(values[borders[0] : borders[-1]], type)
    )


def _signed(words: np.ndarray) -> np.ndarray:
    return words.view(np.int64)


def _unsigned(words: pa.Array) -> np.ndarray:
    return np.array(words, np.int64).view(np.uint64)


# With whole words, arrays go as bytes: Spark copies them whole, and they take the least room.
_TYPES = [np.dtype(x) for x in (np.uint8, np.uint16, np.int32, np.int64, np.float64)]
_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Type, number of bytes, and the values in the narrowest type that holds them, compressed."""
    if values.dtype.kind in "iu":
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        kind = next(t for t in _TYPES[:4] if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    else:
        kind = _TYPES[-1]
    data = np.ascontiguousarray(values, kind).tobytes()
    return bytes([_TYPES.index(kind)]) + len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unpack(packed: pa.BinaryScalar) -> np.ndarray:
    """The values, whole numbers as 64-bit ones."""
    data = memoryview(packed.as_buffer())
    kind, size = _TYPES[data[0]], int.from_bytes(data[1:9], "little")
    values = np.frombuffer(_CODEC.decompress(data[9:], size, asbytes=True), kind)
    return values if kind.kind == "f" else values.astype(np.int64)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([_pack(values)], pa.binary())


def _packs(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """One value for each pair of neighbouring borders."""
    return pa.array([_pack(values[a:b]) for a, b in zip(borders[:-1], borders[1:])], pa.binary())


def _same(packed: pa.BinaryScalar) -> pa.Array:
    return pa.array([packed.as_py()], pa.binary())


def _chunks(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches. No batch is held while the next one is read."""
    for batch in batches:
        lengths = np.array(pc.binary_length(batch.column(text)), np.int64)
        piece = np.cumsum(lengths) // most
        borders = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece))
        for a, b in zip(borders[:-1], borders[1:]) if len(piece) else ():
            yield batch.slice(a, b - a)
        del batch


def _counting(buckets: int, most: int, whole: bool = False) -> Callable:
    """Learnt counts of (word, ending), one row for each bucket of a chunk. With ``whole``, of pairs of
    words, those not learnt with a count of 0."""
    names = ["bucket", "words", "pairs", "context" if whole else "ending", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 0, most):
            learns = part.column(1).to_numpy(zero_copy_only=False)
            texts = part.column(0) if whole else part.column(0).filter(part.column(1))
            del part
            if not len(texts):
                continue
            c = read_tokens(texts, whole)
            if whole:
                counts = np.add.reduceat(learns[c.docs], c.pair_start, dtype=np.int64)
            else:
                counts = np.diff(np.append(c.pair_start, len(c.docs)))
            borders = _borders(_bucket(c.words, buckets))
            pairs = np.searchsorted(c.pair_word, borders)
            columns = [pa.array(_bucket(c.words, buckets)[borders[:-1]])]
            if whole:
                columns += [_packs(x, borders) for x in (_signed(c.words), np.bincount(c.pair_word))]
                columns += [_packs(x, pairs) for x in (_signed(c.pair_context), counts)]
            else:
                columns += [
                    _lists(_signed(c.words), borders, pa.int64()),
                    _lists(np.bincount(c.pair_word).astype(np.int32), borders, pa.int32()),
                    _lists(c.pair_ending.astype(np.int32), pairs, pa.int32()),
                    _lists(counts, pairs, pa.int64()),
                ]
            del c, texts
            yield pa.RecordBatch.from_arrays(columns, names=names)
            del columns

    return run


def _borders(sorted_values: np.ndarray) -> np.ndarray:
    changed = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate([[0], changed, [len(sorted_values)]]).astype(np.int64)


_COUNTED = "bucket int, words array<bigint>, pairs array<int>, ending array<int>, count array<bigint>"
_SEATS = [f"{name}{level} array<bigint>" for level in (2, 1, 0) for name in ("section", "size", "tables")]
_STATE = ", ".join(
    [_COUNTED, *_SEATS]
    + [f"sample{level} array<bigint>" for level in (2, 1, 0)]
    + ["total_key array<int>", "total array<bigint>"]
)
_STATE_NAMES = [column.split()[0] for column in _STATE.split(", ")]
_NOTHING = {name: pa.array([[]], pa.list_(pa.int64())) for name in _STATE_NAMES[5:-2]}

# With whole words: sections of the words before. Those of one token keep their one table whatever
# happens; ``single`` counts them in each section below. The others are ``live``.
_PAIRS_COUNTED = "bucket int, words binary, pairs binary, context binary, count binary"
_LIVE = "single binary, lives binary, keys binary, context binary, count3 binary"
_ASKED = "asked binary, sections binary, tokens binary, new_word binary, new_at binary"
_TOTALS = "total_key array<int>, total array<bigint>"
_SECTIONS = "bucket int, words binary, pairs binary, ending binary"
_SEATED = ", ".join(f"{name} binary" for name in _NOTHING)
_LIVE_STATE = (
    f"{_SECTIONS}, {_SEATED}, {_TOTALS}, {_LIVE}, first binary, section3 binary, size3 binary, "
    "tables3 binary, sample3 binary"
)
_LIVE_COUNTED = f"{_SECTIONS}, count binary, {_LIVE}, {_ASKED}, {_TOTALS}"

# Keys of what is gathered: tables by restaurant of each level, then customers, then single numbers.
_T2, _T1, _T0, _C2 = 0, ENDINGS, ENDINGS + LETTERS, 2 * ENDINGS
_N, _V, _ONES, _PAIRS = (3 * ENDINGS + i for i in (0, 1, 2, 16))
SHARES = (4000, 1000, 250, 60, 8)  # a word is frequent above one token in so many
PAIR_SHARES = tuple(1 << k for k in range(36, 2, -1))  # a pair of words is
_FOLD = 1 << 20
_AT_ONCE = 1 << 15  # pairs scored at once, in about
_FIRST = 22  # bits of a key that are looked at first
_ROUNDS = 2  # in which documents are scored
_CHUNKS_BYTES, _BUCKETS_BYTES = 12 << 20, 1 << 20  # of Arrow batches, of texts and of buckets' rows


@dataclass
class Words:
    """The rows of one bucket: words, and their sections in the three levels of restaurants."""

    words: np.ndarray
    of: list[np.ndarray]  # by level: the word's place (level 0), restaurant key of each section
    word: list[np.ndarray]
    parent: list[np.ndarray]  # by level: section's place in the level below

    @classmethod
    def read(cls, words: np.ndarray, pairs: np.ndarray, ending: np.ndarray) -> Words:
        word = np.repeat(np.arange(len(words)), pairs)
        key = word * LETTERS + (ending >> 8)
        letters, parent = np.unique(key, return_inverse=True)
        return cls(
            words,
            [np.zeros(len(words), np.int64), letters % LETTERS, ending],
            [np.arange(len(words)), letters // LETTERS, word],
            [np.zeros(len(words), np.int64), letters // LETTERS, parent],
        )


@dataclass(frozen=True)
class Totals:
    """Tables and customers of all restaurants, by level; discounts; training tokens and words."""

    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    customers: tuple[np.ndarray, np.ndarray, np.ndarray]
    discount: tuple[float, ...]
    strength: float
    n: int
    v: int

    def backoff(self, level: int, restaurant: np.ndarray) -> np.ndarray:
        tables, customers = self.tables[level][restaurant], self.customers[level][restaurant]
        return (self.strength + self.discount[level] * tables) / (self.strength + customers)

    def seen(self, level: int, restaurant: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount[level] * tables) / (self.strength + self.customers[level][restaurant])

    def predicted(self, w: Words, level: int, customers: list, tables: list) -> np.ndarray:
        """Probability of every section's word in its restaurant."""
        below = 1 / (self.v + 1) if level == 0 else self.predicted(w, level - 1, customers, tables)[w.parent[level]]
        own = self.seen(level, w.of[level], customers[level], tables[level])
        return own + self.backoff(level, w.of[level]) * below


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's rows, in one."""
    sums = np.zeros(4 * ENDINGS, np.int64)
    for batch in batches:
        for key, total in zip(*batch.columns):
            sums[np.array(key.values)] += np.array(total.values)
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([_ints(some), _one(sums[some])], names=["total_key", "total"])


def _totals(rows: DataFrame, known: Totals | None, settings: Settings) -> tuple[Totals, dict[int, int]]:
    """What the buckets' rows say of all restaurants; at most 3 * 65,536 numbers and some."""
    rows = rows.select("total_key", "total").mapInArrow(_added, "total_key array<int>, total array<bigint>")
    pairs = rows.select(F.explode(F.arrays_zip("total_key", "total")).alias("t"))
    found = pairs.groupBy(F.col("t.total_key").alias("k")).agg(F.sum("t.total").alias("n")).collect()
    numbers = np.zeros(4 * ENDINGS, np.int64)
    for key, n in found:
        numbers[key] = n
    tables = (numbers[_T0 : _T0 + 1], numbers[_T1 : _T1 + LETTERS], numbers[_T2 : _T2 + ENDINGS])
    c2 = numbers[_C2 : _C2 + ENDINGS]
    c1 = tables[2].reshape(LETTERS, -1).sum(axis=1)
    customers = (tables[1].sum(keepdims=True), c1, c2)
    if known:
        discount, n, v = known.discount, known.n, known.v
    else:
        discount = tuple(
            float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
            for a, b in (numbers[_ONES + 2 * level :][:2] for level in range(4))
        )
        n, v = int(numbers[_N]), int(numbers[_V])
    return Totals(tables, customers, discount, settings.strength, n, v), {
        share: int(numbers[_PAIRS + i]) for i, share in enumerate(_shares(settings))
    }


def _shares(settings: Settings) -> tuple[int, ...]:
    return PAIR_SHARES if settings.whole else SHARES


def _total_arrays(w: Words, tables: list[np.ndarray], extra: list[tuple[int, int]], c2: np.ndarray) -> list:
    keys, values = [], []
    for base, restaurant, number in [
        (_T2, w.of[2], tables[2]),
        (_T1, w.of[1], tables[1]),
        (_T0, w.of[0], tables[0]),
        (_C2, w.of[2], c2),
    ]:
        sums = np.bincount(restaurant, number).astype(np.int64)
        some = np.flatnonzero(sums)
        keys.append(base + some)
        values.append(sums[some])
    keys.append(np.array([k for k, _ in extra]))
    values.append(np.array([v for _, v in extra]))
    return [pa.array([np.concatenate(keys).astype(np.int32)], pa.list_(pa.int32())), _one(np.concatenate(values))]


def _one(values: np.ndarray) -> pa.Array:
    return pa.array([np.asarray(values, np.int64)], pa.list_(pa.int64()))


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array([np.asarray(values, np.int32)], pa.list_(pa.int32()))


def _folded(parts: list[tuple]) -> tuple:
    """Words, pairs, endings and counts of several counted rows as those of one."""
    words, pairs, ending, count = (np.concatenate(x) for x in zip(*parts))
    hashes, place = np.unique(words.view(np.uint64), return_inverse=True)
    section = np.repeat(place, pairs) * ENDINGS
    section += ending
    section, found = np.unique(section, return_inverse=True)
    count = np.bincount(found, count).astype(np.int64)
    pairs = np.bincount(section >> 16, minlength=len(hashes))
    return _signed(hashes), pairs.astype(np.int32), (section & (ENDINGS - 1)).astype(np.int32), count


def _folded_whole(parts: list[tuple]) -> tuple:
    """The same with whole words before, in the order of their codes."""
    words, pairs, context, count = (np.concatenate(x) for x in zip(*parts))
    hashes, place = np.unique(words.view(np.uint64), return_inverse=True)
    codes, at = np.unique(context.view(np.uint64), return_inverse=True)
    section = np.repeat(place, pairs) * len(codes)
    section += at
    order = ordered(section)
    section = section[order]
    start = np.flatnonzero(np.append(True, section[1:] != section[:-1]))
    section, count = section[start], np.add.reduceat(count[order], start)
    pairs = np.bincount(section // len(codes), minlength=len(hashes))
    return _signed(hashes), pairs.astype(np.int32), _signed(codes[section % len(codes)]), count


def _merging(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """One row of all counted rows of a bucket, and the totals of a seating with one table each.

    Rows come sorted by bucket. They are folded whenever about ``_FOLD`` pairs have come, so that what
    is held follows from the words of the bucket, not from the number of chunks that have them."""
    fold, finish = (_folded_whole, _merged_whole) if whole else (_folded, _merged)
    at, held, size = None, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            if (bucket := batch.column(0)[i].as_py()) != at:
                if held:
                    yield finish(at, *fold(held))
                at, held, size = bucket, [], 0
            values = (batch.column(c)[i] for c in range(1, 5))
            held.append(tuple(_unpack(x) if whole else np.array(x.values) for x in values))
            size += len(held[-1][2])
            if size > _FOLD:
                held = [fold(held)]
                size = min(size, len(held[0][2])) // 2  # a large bucket is not folded with every row
        del batch
    if held:
        yield finish(at, *fold(held))


def _ones(sizes: list[np.ndarray]) -> list[tuple[int, int]]:
    """How many sections of each level have one and two customers."""
    return [
        (_ONES + 2 * level + k, int((size == k + 1).sum())) for level, size in enumerate(sizes) for k in (0, 1)
    ]


def _merged(bucket: int, words: np.ndarray, pairs: np.ndarray, ending: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    w = Words.read(words.view(np.uint64), pairs, ending.astype(np.int64))
    sizes = [np.bincount(w.parent[1], minlength=len(words)), np.bincount(w.parent[2]), count]
    extra = [(_N, int(count.sum())), (_V, len(words)), *_ones(sizes)]
    totals = _total_arrays(w, [np.ones(len(x), np.int64) for x in w.of], extra, count)
    columns = [pa.array([bucket], pa.int32()), _one(words), _ints(pairs), _ints(ending), _one(count)]
    return pa.RecordBatch.from_arrays([*columns, *_NOTHING.values(), *totals], names=_STATE_NAMES)


def _merged_whole(
    bucket: int, words: np.ndarray, pairs: np.ndarray, context: np.ndarray, count: np.ndarray
) -> pa.RecordBatch:
    asked, at = np.unique(context.view(np.uint64), return_inverse=True)
    word, learnt = np.repeat(np.arange(len(words)), pairs), count > 0
    sections, tokens = np.bincount(at[learnt], minlength=len(asked)), np.bincount(at, count, len(asked))
    known = np.bincount(word, count, len(words)) > 0
    place = np.cumsum(known) - 1
    new = ~learnt & known[word]
    new_word, new_at = place[word[new]], at[new]
    word, at, count = place[word[learnt]], at[learnt], count[learnt]
    below, parent = np.unique(word * ENDINGS + (asked[at] & np.uint64(ENDINGS - 1)).astype(np.int64), return_inverse=True)
    pairs, ending = np.bincount(below >> 16, minlength=int(known.sum())), below & (ENDINGS - 1)
    words = words[known]
    w = Words.read(words.view(np.uint64), pairs, ending)
    children = np.bincount(parent, minlength=len(below))
    sizes = [np.bincount(w.parent[1], minlength=len(words)), np.bincount(w.parent[2]), children, count]
    extra = [(_N, int(count.sum())), (_V, len(words)), *_ones(sizes)]
    totals = _total_arrays(w, [np.ones(len(x), np.int64) for x in w.of], extra, children)
    live = np.flatnonzero(count > 1)
    live = live[np.argsort(parent[live], kind="stable")]
    lives = np.bincount(parent[live], minlength=len(below))
    keys, context = np.unique(at[live], return_inverse=True)
    columns = {
        "bucket": pa.array([bucket], pa.int32()),
        "words": _packed(words),
        "pairs": _packed(pairs),
        "ending": _packed(ending),
        "count": _packed(np.bincount(parent, count, len(below))),
        "single": _packed(children - lives),
        "lives": _packed(lives),
        "keys": _packed(_signed(asked[keys])),
        "context": _packed(context),
        "count3": _packed(count[live]),
        "asked": _packed(_signed(asked)),
        "sections": _packed(sections),
        "tokens": _packed(tokens),
        "new_word": _packed(new_word),
        "new_at": _packed(new_at),
        "total_key": totals[0],
        "total": totals[1],
    }
    return pa.RecordBatch.from_pydict(columns)


def _sweeping(totals: Totals, settings: Settings, sweep: int) -> Callable:
    keep = sweep >= settings.sweeps - settings.samples

    def bucket(row: dict, answers: np.ndarray | None = None) -> pa.RecordBatch:
        rng = np.random.default_rng((settings.seed, sweep, int(row["bucket"].as_py())))
        read = _unpack if settings.whole else lambda x: np.array(x.values)
        array = {
            name: read(row[name])
            for name in row
            if name not in ("bucket", "home", "values", "total_key", "total") and row[name].is_valid
        }
        array |= {name: array[name].astype(np.int64) if name in array else np.empty(0, np.int64) for name in _NOTHING}
        w = Words.read(array["words"].view(np.uint64), array["pairs"], array["ending"])
        n = [len(x) for x in w.of]
        top = _Live.read(array, answers, sweep) if settings.whole else None
        customers: list = [None, None, top.below() if top else array["count"]]
        seats: list = [None] * 3
        tables: list = [None] * 3
        for level in (2, 1, 0):
            # Of sections with a customer alone no seats are kept: one table.
            seats[level] = Seats(*(array[f"{x}{level}"] for x in ("section", "size", "tables")))
            tables[level] = np.maximum(seats[level].table_counts(n[level]), 1)
            if level:
                customers[level - 1] = np.bincount(w.parent[level], tables[level], n[level - 1]).astype(np.int64)
        if top:
            top.move(totals.predicted(w, 2, customers, tables), totals, settings.moves, rng)
            customers[2] = top.below()
        for level in (2, 1, 0):
            if level:
                parent = totals.predicted(w, level - 1, customers, tables)[w.parent[level]]
            else:
                parent = np.full(n[0], 1 / (totals.v + 1))
            d = totals.discount[level]
            others = totals.tables[level][w.of[level]] - tables[level]
            worth = Worth((totals.strength + d * np.maximum(others, 0)) * parent, d * parent)
            several = np.flatnonzero(customers[level] > 1)
            if sweep:
                sat = np.where(customers[level] > 1, customers[level], 0)
                stored = seats[level].where(sat[seats[level].section] > 0)
                new = several[stored.table_counts(n[level])[several] == 0]
                one = np.ones(len(new), np.int64)
                seats[level] = adjusted(merged(stored, Seats(new, one, one)), sat, worth, d, rng)
            else:
                part = Worth(worth.base[several], worth.slope[several])
                seats[level] = seat(several, customers[level][several], part, d, rng)
            seats[level] = gibbs(seats[level], customers[level], worth, d, settings.moves, rng)
            tables[level] = np.maximum(seats[level].table_counts(n[level]), 1)
            if level:
                customers[level - 1] = np.bincount(w.parent[level], tables[level], n[level - 1]).astype(np.int64)
        numbers, again = (_packed, _same) if top else (_one, _again)
        columns = [row[c] for c in ("bucket", "words", "pairs", "ending", *(() if top else ("count",)))]
        columns = [pa.array([c.as_py()], pa.int32()) if i == 0 else again(c) for i, c in enumerate(columns)]
        for level in (2, 1, 0):
            columns += [numbers(seats[level].section), numbers(seats[level].size), numbers(seats[level].tables)]
        for level in (2, 1, 0):
            kept = array[f"sample{level}"]
            columns.append(numbers(np.append(kept, tables[level]) if keep else kept))
        if top:
            often = [int((top.count * share > totals.n).sum()) for share in PAIR_SHARES]
        else:
            per_word = np.bincount(w.word[2], array["count"], n[0])
            n_pairs = np.bincount(w.word[2], minlength=n[0])
            often = [int(n_pairs[per_word * share > totals.n].sum()) for share in SHARES]
        extra = [(_PAIRS + i, found) for i, found in enumerate(often)]
        columns += _total_arrays(w, tables, extra, customers[2])
        if top:
            kept = array.get("sample3", np.empty(0, np.int64))
            columns += [_same(row[c]) for c in ("single", "lives", "keys", "context", "count3")]
            columns += [_packed(top.first), *top.written(), _packed(np.append(kept, top.tables) if keep else kept)]
        return pa.RecordBatch.from_arrays(columns, names=_names(_LIVE_STATE) if top else _STATE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if settings.whole:
            for rows, answers in _by_bucket(batches, 1):
                yield bucket(rows[-1], answers)
            return
        for batch in batches:
            for i in range(batch.num_rows):
                yield bucket({name: batch.column(name)[i] for name in batch.schema.names})

    return run


def _names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


@dataclass
class _Live:
    """The sections of one bucket's words in the restaurants of whole words, where two or more
    customers sit; ``known`` is the number of tables of each restaurant ``keys`` names."""

    count: np.ndarray
    parent: np.ndarray
    single: np.ndarray
    context: np.ndarray
    first: np.ndarray
    known: np.ndarray
    seats: Seats | None
    tables: np.ndarray

    @classmethod
    def read(cls, array: dict, answers: np.ndarray, sweep: int) -> _Live:
        count = array["count3"].astype(np.int64)
        if sweep:
            first, known = array["first"], array["first"] + answers[:, 0]
            seats = Seats(*(array[f"{x}3"].astype(np.int64) for x in ("section", "size", "tables")))
            tables = seats.table_counts(len(count))
        else:
            asked, keys = (array[x].view(np.uint64) for x in ("asked", "keys"))
            first = known = answers[np.searchsorted(asked, keys), 0]
            seats, tables = None, np.ones(len(count), np.int64)
        parent = np.repeat(np.arange(len(array["lives"])), array["lives"])
        return cls(count, parent, array["single"], array["context"], first, known, seats, tables)

    def below(self) -> np.ndarray:
        """Customers of the sections below."""
        return (self.single + np.bincount(self.parent, self.tables, len(self.single))).astype(np.int64)

    def move(self, predicted: np.ndarray, totals: Totals, moves: int, rng: np.random.Generator) -> None:
        parent, d = predicted[self.parent], totals.discount[3]
        others = self.known[self.context] - self.tables
        worth = Worth((totals.strength + d * np.maximum(others, 0)) * parent, d * parent)
        if self.seats is None:
            self.seats = seat(np.arange(len(self.count)), self.count, worth, d, rng)
        self.seats = gibbs(self.seats, self.count, worth, d, moves, rng)
        self.tables = self.seats.table_counts(len(self.count))

    def written(self) -> list[pa.Array]:
        return [_packed(self.seats.section), _packed(self.seats.size), _packed(self.seats.tables)]


_VALUES = "home int, bucket int, keys binary, values binary"
_ANSWERS = "home int, bucket int, values binary"


def _asking(homes: int, sweep: int, settings: Settings) -> Callable:
    """What a bucket knows of the restaurants of whole words, by the home of their keys, to be summed up:
    before the first sweep their sections, then tables beyond the first of each section; after the
    last one (``sweep`` is their number) tokens, and tables in each sample. Rows of buckets below zero
    get no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                bucket, ends = row["bucket"].as_py(), sweep == settings.sweeps
                array = {n: _unpack(row[n]) for n in row if n != "bucket" and row[n].is_valid}
                if "asked" in array:
                    keys, n = array["asked"], array["sections"]
                    values = np.stack([array["tokens"]] + [n] * settings.samples, 1) if ends else n[:, None]
                else:
                    keys, context, n = array["keys"], array["context"], len(array["count3"])
                    if not n:
                        continue
                    if ends:
                        bucket, more = -1 - bucket, array["sample3"].reshape(-1, n) - 1
                    else:
                        more = [np.bincount(array["section3"], array["tables3"], n) - 1]
                    sums = [np.bincount(context, x, len(keys)) for x in more]
                    values = np.stack([np.zeros(len(keys))] * ends + sums, 1).astype(np.int64)
                home = _bucket(keys.view(np.uint64), homes)
                borders = _borders(home)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(home[borders[:-1]]),
                        pa.array(np.full(len(borders) - 1, bucket, np.int32)),
                        _packs(keys, borders),
                        _packs(values.ravel(), borders * values.shape[1]),
                    ],
                    names=_names(_VALUES),
                )
            del batch

    return run


def _answering(rows: pa.Table) -> pa.Table:
    """Sums over all buckets, for each row in the order of its keys."""
    keys = [_unpack(x) for x in rows["keys"]]
    n, keys = np.array([len(x) for x in keys]), np.concatenate(keys)
    values = np.concatenate([_unpack(x) for x in rows["values"]]).reshape(len(keys), -1)
    place = np.unique(keys, return_inverse=True)[1]
    sums = np.stack([np.bincount(place, v) for v in values.T], 1).astype(np.int64)
    wanted = rows["bucket"].to_numpy() >= 0
    borders = np.append(0, np.cumsum(n[wanted])) * values.shape[1]
    own = rows.select(["home", "bucket"]).filter(pa.array(wanted))
    return own.append_column("values", _packs(sums[place[np.repeat(wanted, n)]].ravel(), borders))


def _answers(asks: DataFrame) -> DataFrame:
    return asks.groupBy("home").applyInArrow(_answering, _ANSWERS)


def _sorted_with(answers: DataFrame, *tables: DataFrame) -> DataFrame:
    """Rows of each bucket together: those of the tables, in their order, then the answers by home."""
    rows = answers
    for i, table in enumerate(reversed(tables)):
        rows = rows.unionByName(table.withColumn("home", F.lit(-1 - i)), allowMissingColumns=True)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "home")


def _by_bucket(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[dict], np.ndarray]]:
    """For each bucket its rows of tables, and its answers, ``width`` numbers for each key."""
    at, rows, answers = None, [], []
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, home = batch.column("bucket")[i].as_py(), batch.column("home")[i].as_py()
            if bucket != at:
                if rows:
                    yield rows, _table(answers, width)
                at, rows, answers = bucket, [], []
            if home < 0:
                rows.append({n: batch.column(n)[i] for n in batch.schema.names})
            else:
                answers.append(_unpack(batch.column("values")[i]))
        del batch
    if rows:
        yield rows, _table(answers, width)


def _table(answers: list[np.ndarray], width: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *answers]).reshape(-1, width)


_SAMPLES = "sample2 array<bigint>, sample1 array<bigint>, sample0 array<bigint>"
_FITTED = (
    f"{_SECTIONS}, count binary, sample2 binary, sample1 binary, sample0 binary, single binary, lives binary, "
    "live_at binary, count3 binary, sample3 binary, new_word binary, new_at binary, asked binary, "
    "customers binary, known binary"
)


def _fitting(samples: int) -> Callable:
    """What scores need of a bucket, in one row; ``known`` are tables of the restaurants of all words
    ``asked``, one sample after the other, ``customers`` those who sit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (counted, state), answers in _by_bucket(batches, 1 + samples):
            asked, keys = (_unpack(x).view(np.uint64) for x in (counted["asked"], state["keys"]))
            columns = [pa.array([counted["bucket"].as_py()], pa.int32())]
            columns += [_same(counted[c]) for c in ("words", "pairs", "ending", "count")]
            columns += [_same(state[f"sample{level}"]) for level in (2, 1, 0)]
            columns += [_same(counted[c]) for c in ("single", "lives")]
            columns += [_packed(np.searchsorted(asked, keys)[_unpack(counted["context"])])]
            columns += [_same(state[c]) for c in ("count3", "sample3")]
            columns += [_same(counted[c]) for c in ("new_word", "new_at", "asked")]
            columns += [_packed(answers[:, 0]), _packed(answers[:, 1:].T.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_FITTED))

    return run


def _again(scalar: pa.ListScalar) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(scalar.values)], pa.int32()), scalar.values)


@dataclass
class _Pairs:
    """Sections of whole words in one bucket: contexts (sorted), their customers and, by sample, tables;
    sections of several customers with theirs; and pairs nobody sits at. All other pairs that
    occur are one customer at one table."""

    asked: np.ndarray
    customers: np.ndarray
    known: np.ndarray
    live: np.ndarray  # word * number of contexts + context, sorted
    count: np.ndarray
    tables: np.ndarray
    new: np.ndarray  # likewise

    def find(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each context, of each pair among the live ones, and whether it is alone."""
        order, at = np.argsort(context), np.empty(len(context), np.int64)
        at[order] = np.searchsorted(self.asked, context[order])  # in order, it stays near in memory
        key = word * len(self.asked) + at
        live = np.where(word < 0, -1, _places(self.live, key))
        alone = (word >= 0) & (live < 0)
        alone[alone] = _places(self.new, key[alone]) < 0
        return at, live, alone

    def predicted(self, found: tuple, sample: int, below: np.ndarray, totals: Totals) -> np.ndarray:
        at, live, alone = found
        own, hit = alone * (1 - totals.discount[3]), live >= 0
        if hit.any():
            own[hit] = self.count[live[hit]] - totals.discount[3] * self.tables[sample][live[hit]]
        more = totals.strength + totals.discount[3] * self.known[sample][at]
        return (own + more * below) / (totals.strength + self.customers[at])


@dataclass
class _Often:
    """Pairs of words scored where they stand: sorted keys, training counts of the second words, scores."""

    keys: np.ndarray
    count: np.ndarray
    score: np.ndarray

    def finder(self) -> Callable:
        """Places of keys, -1 where they are not. Most keys are told by their first bits, which takes a
        fraction of the time."""
        first = np.zeros(1 << _FIRST, bool)
        first[(self.keys >> np.uint64(64 - _FIRST)).astype(np.int64)] = True

        def find(wanted: np.ndarray) -> np.ndarray:
            some = np.flatnonzero(first[(wanted >> np.uint64(64 - _FIRST)).astype(np.int64)])
            places = np.full(len(wanted), -1)
            places[some] = _places(self.keys, wanted[some])
            return places

        return find


def _mixed(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return words ^ contexts * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Fitted:
    """Words of one bucket, or the frequent ones of all, with their kept seatings."""

    words: np.ndarray
    count: np.ndarray
    keys: list[np.ndarray]  # of the sections, by level: word, word and letter, word and ending
    customers: list[list[np.ndarray]]  # by level and sample
    tables: list[list[np.ndarray]]
    pairs: _Pairs | None = None  # with whole words
    below: list[np.ndarray] | None = None  # then, chances of the sections of endings, by sample

    @classmethod
    def read(cls, words, pairs, ending, count, kept: list[np.ndarray]) -> Fitted:
        """``kept``: numbers of tables, by level, one sample after the other."""
        w = Words.read(words, pairs, ending)
        tables = [k.reshape(-1, len(x)) if len(x) else np.empty((1, 0), np.int64) for k, x in zip(kept, w.of)]
        customers = [
            [np.bincount(w.parent[level + 1], t, len(w.of[level])) for t in tables[level + 1]] for level in (0, 1)
        ]
        customers.append([count] * len(tables[2]))
        keys = [w.word[0], w.word[1] * LETTERS + w.of[1], w.word[2] * ENDINGS + w.of[2]]
        return cls(words, np.bincount(w.word[2], count, len(words)), keys, customers, tables)

    @classmethod
    def read_whole(cls, row: dict[str, np.ndarray]) -> Fitted:
        words, pairs, ending = row["words"].view(np.uint64), row["pairs"], row["ending"]
        fitted = cls.read(words, pairs, ending, row["count"], [row[f"sample{level}"] for level in range(3)])
        below = np.repeat(np.arange(len(ending)), row["lives"])
        asked = row["asked"].view(np.uint64)
        tables = row["sample3"].reshape(-1, len(below)) if len(below) else np.empty((1, 0), np.int64)
        if len(below):
            fitted.customers[2] = [row["single"] + np.bincount(below, t, len(ending)) for t in tables]
        else:
            fitted.customers[2] = [row["single"]] * len(fitted.tables[2])
        key = np.repeat(np.arange(len(words)), pairs)[below] * len(asked) + row["live_at"]
        order = np.argsort(key)
        new = row["new_word"].astype(np.int64) * len(asked) + row["new_at"]
        known = row["known"].reshape(-1, len(asked))
        fitted.pairs = _Pairs(asked, row["customers"], known, key[order], row["count3"][order], tables[:, order], new)
        return fitted

    @classmethod
    def empty(cls) -> Fitted:
        return cls.read(np.empty(0, np.uint64), *([np.empty(0, np.int64)] * 3), [np.empty(0, np.int64)] * 3)

    def scores(
        self,
        words: np.ndarray,
        word: np.ndarray,
        ending: np.ndarray,
        totals: list[Totals],
        context: np.ndarray | None = None,
    ) -> tuple:
        """Training counts of ``words``, and the log10 of the mean predictive probability of each
        pair of a place in ``words`` and an ending, or the ``context`` that has it."""
        place = np.searchsorted(self.words, words)
        known = place < len(self.words)
        known[known] = self.words[place[known]] == words[known]
        place = np.where(known, place, -1)
        count = np.where(known, self.count[place], 0) if len(self.words) else np.zeros(len(words))
        mine = place[word]
        if context is None:
            return count, np.log10(sum(self._chances(mine, ending, totals)) / len(totals))
        if self.below is None:
            self.below = self._chances(self.keys[2] // ENDINGS, self.keys[2] % ENDINGS, totals)
        at, found = _places(self.keys[2], mine * ENDINGS + ending), self.pairs.find(mine, context)
        miss, mean = np.flatnonzero(at < 0), np.zeros(len(word))
        for s, (t, missed) in enumerate(zip(totals, self._chances(mine[miss], ending[miss], totals))):
            below = self.below[s][at] if len(self.keys[2]) else np.empty(len(at))
            below[miss] = missed
            mean += self.pairs.predicted(found, s, below, t)
        return count, np.log10(mean / len(totals))

    def _chances(self, mine: np.ndarray, ending: np.ndarray, totals: list[Totals]) -> list[np.ndarray]:
        """Predictive probabilities, by sample, of each pair of a word's place (-1: unknown) and an ending."""
        letter = ending >> 8
        sections = [_places(self.keys[0], mine), _places(self.keys[1], mine * LETTERS + letter), _places(self.keys[2], mine * ENDINGS + ending)]
        restaurants = [np.zeros(len(mine), np.int64), letter, ending]
        chances = []
        for s, t in enumerate(totals):
            below = np.full(len(mine), 1 / (t.v + 1))
            for level in range(3):
                at, seen = sections[level], np.zeros(len(mine))
                hit = at >= 0
                if hit.any():
                    customers, tables = self.customers[level][s][at[hit]], self.tables[level][s][at[hit]]
                    seen[hit] = t.seen(level, restaurants[level][hit], customers, tables)
                below = seen + t.backoff(level, restaurants[level]) * below
            chances.append(below)
        return chances


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _frequent(states: DataFrame, share: int | None, totals: Totals) -> Fitted:
    """The words above one token in ``share``: no more than ``Settings.here`` pairs."""
    if share is None:
        return Fitted.empty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: np.array(batch.column(name)[i].values) for name in batch.schema.names}
                w = Words.read(row["words"], row["pairs"], row["ending"])
                often = np.bincount(w.word[2], row["count"], len(w.words)) * share > totals.n
                if not often.any():
                    continue
                mine = [often[w.word[level]] for level in range(3)]
                kept = [row[f"sample{level}"].reshape(-1, len(mine[level]))[:, mine[level]].T for level in range(3)]
                columns = [_one(row["words"][often]), _one(row["pairs"][often])]
                columns += [_one(row[c][mine[2]]) for c in ("ending", "count")]
                columns += [_one(kept[level].ravel()) for level in range(3)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["words", "pairs", "ending", "count", "sample0", "sample1", "sample2"]
    rows = states.select(*names).mapInArrow(run, ", ".join(f"{n} array<bigint>" for n in names)).toArrow()
    if not rows.num_rows:
        return Fitted.empty()
    # Rows of the buckets in the order of their words; samples lie side by side for each section.
    first = [row[0].as_py() & ((1 << 64) - 1) for row in rows["words"]]
    rows = rows.take(np.argsort(np.array(first, np.uint64))).combine_chunks()
    flat = {name: pc.list_flatten(rows[name]).to_numpy() for name in names}
    n = [len(flat["words"]), None, len(flat["ending"])]
    samples = len(flat["sample0"]) // n[0]
    kept = [flat[f"sample{level}"].reshape(-1, samples).T.copy().ravel() for level in range(3)]
    return Fitted.read(flat["words"].view(np.uint64), flat["pairs"], flat["ending"], flat["count"], kept)


def _frequent_pairs(fitted: DataFrame, share: int | None, totals: list[Totals]) -> _Often:
    """The pairs above one token in ``share``: no more than ``Settings.here``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: _unpack(batch.column(n)[i]) for n in batch.schema.names}
                often = np.flatnonzero(row["count3"].astype(np.int64) * share > totals[0].n)
                if not len(often):
                    continue
                below = np.repeat(np.arange(len(row["ending"])), row["lives"])[often]
                word = np.repeat(np.arange(len(row["words"])), row["pairs"])[below]
                words, context = row["words"].view(np.uint64), row["asked"].view(np.uint64)[row["live_at"][often]]
                ending = row["ending"][below].astype(np.int64)
                count, score = Fitted.read_whole(row).scores(words, word, ending, totals, context)
                columns = [_signed(_mixed(words[word], context)), count[word].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, score)], names=["key", "count", "score"])
            del batch

    if share is None:
        return _Often(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))
    rows = fitted.drop("bucket").mapInArrow(run, "key bigint, count bigint, score double").toArrow()
    keys, count, score = (rows[c].to_numpy() for c in ("key", "count", "score"))
    order = np.argsort(keys.view(np.uint64))
    return _Often(keys.view(np.uint64)[order], count[order], score[order])


_SENT = (
    "bucket bigint, chunk bigint, words array<bigint>, pairs array<int>, ending array<int>, "
    "count array<bigint>, sample2 array<bigint>, sample1 array<bigint>, sample0 array<bigint>, "
    "seen array<int>, docs array<int>"
)
_SENT_PAIRS = "bucket bigint, chunk bigint, words binary, pairs binary, context binary, seen binary, docs binary"
_SUMS = "docs array<int>, known array<bigint>, base array<double>, score array<double>"
_OWN = "ids array<{id}>, held_out array<boolean>, n_tokens array<bigint>"


def _sums(docs: np.ndarray, n: int, known, base, score, packed: bool = False) -> list[pa.Array]:
    """Sums over the tokens of each document that has any here."""
    present = np.flatnonzero(np.bincount(docs, minlength=n))
    known = np.bincount(docs, known, n)[present].astype(np.int64)
    sums = [np.bincount(docs, x, n)[present] for x in (base, score)]
    if packed:
        return [_packed(x) for x in (present, known, *sums)]
    return [_ints(present), _one(known), *(pa.array([x], pa.list_(pa.float64())) for x in sums)]


def _base(count: np.ndarray, totals: Totals) -> np.ndarray:
    return np.log10((count + 1) / (totals.n + totals.v + 1))


def _rows(schema: pa.Schema, n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _sending(
    often: Fitted | _Often, totals: list[Totals], buckets: int, most: int, schema: pa.Schema
) -> Callable:
    """Tokens of a chunk for each bucket, and one row of its documents with what the frequent words,
    or pairs of words, give. These rows have buckets below zero, as many as there are chunks."""
    whole = isinstance(often, _Often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        find = often.finder() if whole else None
        for part in _chunks(batches, 2, most):
            c = read_tokens(part.column(2), whole)
            n_docs, seen = part.num_rows, np.diff(np.append(c.pair_start, len(c.docs)))
            if whole:
                place = find(_mixed(c.words[c.pair_word], c.pair_context))
                mine = place >= 0
                count, score = often.count[place[mine]], often.score[place[mine]]
            else:
                count, score = often.scores(c.words, c.pair_word, c.pair_ending, totals)
                mine = count[c.pair_word] > 0
                count, score = count[c.pair_word[mine]], score[mine]
            tokens = np.repeat(mine, seen)
            values = [np.repeat(x, seen[mine]) for x in (np.ones(len(score)), _base(count, totals[0]), score)]
            own = dict(zip(("docs", "known", "base", "score"), _sums(c.docs[tokens], n_docs, *values, packed=whole)))
            all_docs = pa.array([0, n_docs], pa.int32())
            held = pc.invert(part.column(1))
            yield _rows(
                schema,
                1,
                {
                    "bucket": pa.array([-1 - chunk]),
                    "chunk": pa.array([chunk]),
                    "ids": pa.ListArray.from_arrays(all_docs, part.column(0)),
                    "held_out": pa.ListArray.from_arrays(all_docs, held),
                    "n_tokens": _one(c.n_tokens),
                    **own,
                },
            )
            away, pair_word = np.unique(c.pair_word[~mine], return_inverse=True)
            words = c.words[away]
            if len(words):
                borders = _borders(_bucket(words, buckets))
                pairs = np.searchsorted(pair_word, borders)
                starts = np.append(0, np.cumsum(seen[~mine]))
                some = c.pair_context[~mine] if whole else c.pair_ending[~mine].astype(np.int32)
                sent = {
                    "words": (_signed(words), borders, pa.int64()),
                    "pairs": (np.bincount(pair_word).astype(np.int32), borders, pa.int32()),
                    "context" if whole else "ending": (_signed(some) if whole else some, pairs, pa.int32()),
                    "seen": (seen[~mine].astype(np.int32), pairs, pa.int32()),
                    "docs": (c.docs[~tokens], starts[pairs], pa.int32()),
                }
                yield _rows(
                    schema,
                    len(borders) - 1,
                    {
                        "bucket": pa.array(_bucket(words, buckets)[borders[:-1]], pa.int64()),
                        "chunk": pa.array(np.full(len(borders) - 1, chunk)),
                        **{name: _packs(*x[:2]) if whole else _lists(*x) for name, x in sent.items()},
                    },
                )
            chunk += 1
            del part, c, tokens, values, own, held

    return run


def _scoring(totals: list[Totals], schema: pa.Schema, whole: bool = False) -> Callable:
    """Sums per document of the tokens sent to a bucket, whose fitted words come first."""
    read = _unpack if whole else lambda x: np.array(x.values)
    names = ("words", "pairs", "context" if whole else "ending", "seen", "docs")

    def scored(bucket: int, chunks: list[int], rows: list[list], fitted: Fitted) -> Iterator[pa.RecordBatch]:
        """Several rows of a bucket at once."""
        words, pairs, ending = (np.concatenate([row[k] for row in rows]) for k in range(3))
        word, context = np.repeat(np.arange(len(words)), pairs), None
        if whole:
            context, ending = ending.view(np.uint64), ending & (ENDINGS - 1)
        count, score = fitted.scores(words.view(np.uint64), word, ending.astype(np.int64), totals, context)
        each = ((count > 0)[word], _base(count, totals[0])[word], score)
        end = 0
        for chunk, (*_, seen, docs) in zip(chunks, rows):
            start, end = end, end + len(seen)
            values = [np.repeat(x[start:end], seen) for x in each]
            sums = dict(zip(("docs", "known", "base", "score"), _sums(docs, int(docs.max()) + 1, *values, packed=whole)))
            yield _rows(schema, 1, {"chunk": pa.array([chunk]), "bucket": pa.array([bucket]), **sums})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fitted, chunks, held = None, Fitted.empty(), [], []
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i, (bucket, chunk) in enumerate(zip(columns["bucket"].to_pylist(), columns["chunk"].to_pylist())):
                if held and (bucket != at or sum(len(row[2]) for row in held) > _AT_ONCE):
                    yield from scored(at, chunks, held, fitted)
                    chunks, held = [], []
                if bucket < 0:
                    yield batch.slice(i, 1).select(schema.names)
                    continue
                if bucket != at:
                    at, fitted = bucket, Fitted.empty()
                if whole and chunk < 0:
                    fitted = Fitted.read_whole({c: _unpack(columns[c][i]) for c in _names(_FITTED) if c != "bucket"})
                elif chunk < 0:
                    words, pairs, ending, count = (read(columns[c][i]) for c in ("words", "pairs", "ending", "count"))
                    kept = [read(columns[f"sample{level}"][i]) for level in range(3)]
                    fitted = Fitted.read(words.view(np.uint64), pairs, ending, count, kept)
                else:
                    chunks.append(chunk)
                    held.append([read(columns[c][i]) for c in names])
            del batch, columns
        if held:
            yield from scored(at, chunks, held, fitted)

    return run


def _summing(totals: Totals, schema: pa.Schema, whole: bool = False) -> Callable:
    def flat(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([_unpack(x) for x in column]) if whole else pc.list_flatten(column).to_numpy()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["bucket"])).combine_chunks()  # a fixed order of the sums
        own = rows.slice(0, 1)
        n = len(own["ids"][0])
        docs = flat(rows["docs"])
        known, base, score = (np.bincount(docs, flat(rows[x]), n) for x in ("known", "base", "score"))
        return pa.table(
            [
                pc.list_flatten(own["ids"]),
                pc.list_flatten(own["held_out"]),
                pc.list_flatten(own["n_tokens"]),
                pa.array(known.astype(np.int64)),
                pa.array(np.full(n, totals.n, np.int64)),
                pa.array(base),
                pa.array(score),
            ],
            schema=schema,
        )

    return run


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def fit(given: DataFrame, scratch: Scratch, settings: Settings, buckets: int) -> tuple[DataFrame, list[Totals], Fitted]:
    """Kept seatings by bucket, the totals of each kept sweep, and the frequent words.

    ``given``: text, learns. Every sweep is written; the table before it is dropped.
    """
    if settings.whole:
        with _small_batches(scratch, _BUCKETS_BYTES):
            return _fit_whole(given, scratch, settings, buckets)
    counted = given.select("text", "learns").mapInArrow(_counting(buckets, settings.chunk_bytes), _COUNTED)
    counted = counted.repartition("bucket").sortWithinPartitions("bucket")
    state = scratch.write(counted.mapInArrow(_merging, _STATE), "counted")
    totals, _ = _totals(state, None, settings)
    kept, pairs = [], {}
    for sweep in range(settings.sweeps):
        after = scratch.write(state.mapInArrow(_sweeping(totals, settings, sweep), _STATE), "sweep")
        scratch.drop(state)
        state = after
        totals, pairs = _totals(state, totals, settings)
        kept.append(totals)
    share = next((s for s in SHARES if pairs.get(s, 0) <= settings.here), None)
    return state, kept[-settings.samples :], _frequent(state, share, totals)


@contextmanager
def _small_batches(scratch: Scratch, most: int) -> Iterator[None]:
    """Arrow batches of about so many bytes (a row at least), whatever the session's are, for what runs
    here."""
    conf, key = scratch.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def _fit_whole(given: DataFrame, scratch: Scratch, settings: Settings, buckets: int) -> tuple:
    """The same with restaurants of whole words. Each sweep first asks for the tables of these: buckets
    send what they know to the homes of the words before, and get the sums."""
    homes = 1 + buckets // 4
    counting = _counting(buckets, settings.chunk_bytes, True)
    counted = given.select("text", "learns").mapInArrow(counting, _PAIRS_COUNTED)
    counted = counted.repartition("bucket").sortWithinPartitions("bucket")
    with _small_batches(scratch, _CHUNKS_BYTES):
        counted = scratch.write(counted.mapInArrow(partial(_merging, whole=True), _LIVE_COUNTED), "counted")
    totals, _ = _totals(counted, None, settings)
    kept, pairs = [], {}
    state = counted.select(*_names(_SECTIONS), *_names(_LIVE), "asked")
    for sweep in range(settings.sweeps):
        names = ["sections", "asked"] if not sweep else ["context", "section3", "tables3", "count3", "keys"]
        extra = ["tokens"] if not sweep else []
        asks = (state if sweep else counted).select("bucket", *names, *extra)
        answers = _answers(asks.mapInArrow(_asking(homes, sweep, settings), _VALUES))
        both = _sorted_with(answers, state.drop("total_key", "total"))
        after = scratch.write(both.mapInArrow(_sweeping(totals, settings, sweep), _LIVE_STATE), "sweep")
        if sweep:
            scratch.drop(state)
        state = after
        totals, pairs = _totals(state, totals, settings)
        kept.append(totals)
    kept = kept[-settings.samples :]
    asking = _asking(homes, settings.sweeps, settings)
    asks = counted.select("bucket", "asked", "sections", "tokens").mapInArrow(asking, _VALUES)
    more = state.select("bucket", "keys", "context", "count3", "sample3").mapInArrow(asking, _VALUES)
    answers = _answers(asks.unionByName(more))
    known = counted.drop("sections", "tokens", "keys", "count3", "total_key", "total")
    moved = state.select("bucket", "keys", "count3", "sample3", *_names(_SAMPLES))
    rows = _sorted_with(answers, known, moved).mapInArrow(_fitting(settings.samples), _FITTED)
    fitted = scratch.write(rows, "fitted")
    scratch.drop(counted, state)
    share = next((x for x in PAIR_SHARES if pairs.get(x, 0) <= settings.here), None)
    return fitted, kept, _frequent_pairs(fitted, share, kept)


def score(
    docs: DataFrame,
    learns: Column,
    scratch: Scratch,
    id: str = "doc_id",
    text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """Scores of all rows, learnt from those where ``learns`` is true."""
    given = docs.select(F.col(id).alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), text_of(text).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // settings.bucket_bytes
    state, totals, often = fit(given, scratch, settings, buckets)

    id_type = given.schema["id"].dataType.simpleString()
    own = _OWN.format(id=id_type)
    sums = "docs binary, known binary, base binary, score binary" if settings.whole else _SUMS
    sent_ddl = f"{_SENT_PAIRS if settings.whole else _SENT}, {own}, {sums[sums.index('known') :]}"
    sums_ddl = f"bucket bigint, chunk bigint, {own}, {sums}"
    names = _names(_FITTED)[1:] if settings.whole else (*_names(_COUNTED)[1:], *_names(_SAMPLES))
    models = state.select(F.col("bucket").cast("bigint").alias("bucket"), F.lit(-1).cast("bigint").alias("chunk"), *names)
    sending = _sending(often, totals, buckets, settings.chunk_bytes, _arrow(sent_ddl))
    scoring = _scoring(totals, _arrow(sums_ddl), settings.whole)
    out = (
        f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    summing = _summing(totals[-1], _arrow(out), settings.whole)

    def scores(some: DataFrame) -> DataFrame:
        both = some.mapInArrow(sending, sent_ddl).unionByName(models, allowMissingColumns=True)
        both = both.repartition("bucket").sortWithinPartitions("bucket", "chunk")
        sums = both.mapInArrow(scoring, sums_ddl)
        return sums.groupBy("chunk").applyInArrow(summing, out).withColumnRenamed("id", id)

    if not settings.whole:
        return scores(given)
    # Not all tokens are on disk at once.
    turn = F.pmod(F.xxhash64("id"), F.lit(_ROUNDS))
    with _small_batches(scratch, _CHUNKS_BYTES):
        found = [scratch.write(scores(given.where(turn == i)), "scores") for i in range(_ROUNDS)]
    scratch.drop(state)
    return reduce(DataFrame.unionByName, found)
