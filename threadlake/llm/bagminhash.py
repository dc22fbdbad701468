"""Bags of word shingles, and BagMinHash signatures of them, in numpy.

A text's bag holds its five-word shingles with their counts. The signature has one value for each of
``size`` places; two texts agree in a place with a probability equal to their weighted Jaccard
similarity, sum(min) / sum(max) over the counts.

Each shingle runs a Poisson process over time and weight; a point at weight below the shingle's
count counts, and falls on a random place, where the earliest point wins. The weights are
discretised to whole counts and split in a hierarchy of ranges [0, 1), [1, 2), [2, 4), [4, 8) ...,
each with a process of its own and a rate equal to its width: a count of n needs about log2(n)
processes. In the range that holds the count itself, points above it are passed over. Points are
generated in order of time, each from a hash of (shingle, range, number), and a process stops as
soon as it is later than every place's winner so far, so most shingles need one or two points.

Words are runs of anything but ASCII blanks. A text of one to four words has one shingle of all its
words; a text without words has no shingle and no signature.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

SHINGLE = 5

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18  # bytes hashed at a time: their places and values take some 50 times as many
_POSITIONS = 1 << 16  # powers kept for places in a word
_TEXT_BITS = 20
_SLICE_BYTES, _SLICE_TEXTS = 2 << 20, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the argument is overwritten."""
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, odd factors for places in a word and for words, blanks."""
    byte = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    place = mix(np.arange(1, _POSITIONS + 1, dtype=np.uint64) * _MIX1) | np.uint64(1)
    word = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _MIX2) | np.uint64(1)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return byte, place, word, blank


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    content = texts.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts in order, and the number of words of each text."""
    data, offsets = _buffers(texts)
    byte, place, _, blank = _tables()
    hashes, starts = [], []
    at = 0
    while at < len(data):
        stop = min(at + _BLOCK, len(data))
        if stop < len(data):  # end at a blank or at a text's end, so that no word is cut
            text_end = int(offsets[np.searchsorted(offsets, stop)])
            while stop < text_end:
                ahead = min(stop + _BLOCK, text_end)
                tail = np.flatnonzero(blank[data[stop:ahead]])
                if len(tail):
                    stop += int(tail[0])
                    break
                stop = ahead
        part = data[at:stop]
        letters = ~blank[part]
        first = letters.copy()
        first[1:] &= ~letters[:-1]
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        inner = inner[inner < len(part)]
        first[inner] |= letters[inner]
        begin = np.flatnonzero(first)
        if len(begin):
            kept = np.flatnonzero(letters)
            index = np.searchsorted(kept, begin)
            length = np.diff(np.append(index, len(kept)))
            within = np.arange(len(kept)) - np.repeat(index, length)
            values = byte[part[kept]] * place[within & (_POSITIONS - 1)]
            hashes.append(mix(np.add.reduceat(values, index)))
            starts.append(begin + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    where = np.concatenate(starts)
    counts = np.diff(np.searchsorted(where, offsets))
    return np.concatenate(hashes), counts


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle (repeats included), in order of the texts."""
    words, counts = word_hashes(texts)
    factor = _tables()[2]
    doc = np.repeat(np.arange(len(counts)), counts)
    out = words * factor[0]
    for k in range(1, SHINGLE):
        if len(words) > k:
            same = doc[k:] == doc[:-k]
            out[:-k] += np.where(same, words[k:] * factor[k], np.uint64(0))
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = (place + SHINGLE <= counts[doc]) | ((place == 0) & (counts[doc] < SHINGLE))
    return mix(out[kept]), doc[kept]


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), by text and shingle; fewer than 2 ** 20 texts."""
    values, doc = shingles(texts)
    if not len(values):
        return doc, values, doc
    bits = np.uint64(_TEXT_BITS)
    # The text's number in front of the hash's upper bits: one sort groups both. The number of
    # bits is fixed, as equal shingles must have equal hashes in every batch.
    key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> (np.uint64(64) - bits)).astype(np.int64), key << bits, count


def signatures(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """BagMinHash values (texts, size) as unsigned integers, and which texts have any shingle."""
    doc, shingle, weight = bags(texts)
    best = np.full((len(texts), size), np.inf)
    latest = np.full(len(texts), np.inf)
    flat = best.reshape(-1)
    # One process for every range that starts below the count.
    ranges = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    e = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(e)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    room = weight[e] - low
    doc = doc[e]
    step = mix(shingle[e] + level.astype(np.uint64) * _GOLDEN)
    del shingle, e, level, low
    time = np.zeros(len(doc))
    while len(doc):
        step = step + _GOLDEN
        draw = mix(step.copy())
        uniform = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        time = time - np.log1p(-uniform) / width
        going = np.flatnonzero(time < latest[doc])
        if len(going) < len(doc):
            doc, step, time, width, room = (a[going] for a in (doc, step, time, width, room))
            draw = draw[going]
        other = mix(draw ^ _MIX2)
        spot = (other & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)
        height = ((other >> np.uint64(32)) * width.astype(np.uint64)) >> np.uint64(32)
        inside = height.astype(np.int64) < room
        np.minimum.at(flat, (doc * size + spot.astype(np.int64))[inside], time[inside])
        active = doc[np.append(True, doc[1:] != doc[:-1])[: len(doc)]]
        latest[active] = best[active].max(axis=1)
    has = np.isfinite(latest) & np.isfinite(best[:, 0])
    return best.view(np.uint64), has


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(_buffers(texts)[1])


def slices(lengths: np.ndarray, most: int = _SLICE_BYTES) -> list[slice]:
    """Neighbouring texts of bounded size together; a longer text comes alone."""
    out, start, held = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (held + n > most or i - start >= _SLICE_TEXTS):
            out.append(slice(start, i))
            start, held = i, 0
        held += n
    return [*out, slice(start, len(lengths))] if len(lengths) else []


def bands(texts: pa.Array, n_bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band of each text's signature, and which texts have any."""
    parts = [
        signatures(texts.slice(s.start, s.stop - s.start), n_bands * rows)
        for s in slices(byte_lengths(texts))
    ]
    values, has = (np.concatenate(x) for x in zip(*parts))
    values = values.reshape(len(texts), n_bands, rows)
    key = np.arange(1, n_bands + 1, dtype=np.uint64)[None, :] * _GOLDEN + np.uint64(0)
    key = np.repeat(key, len(texts), axis=0)
    for i in range(rows):
        key = mix(key ^ values[:, :, i])
    return key.view(np.int64), has


def compare(left: pa.Array, right: pa.Array) -> dict[str, np.ndarray]:
    """The bags of each pair of texts: weighted Jaccard similarity (0 where one has none), the sum
    of the smaller counts, both sizes, and the shingles of which the left text has more than the
    right one, as often as it has more (all pairs' one after another, with their number by pair)."""
    sides = []
    for texts in (left, right):
        values, doc = shingles(texts)
        order = np.lexsort((values, doc))
        values, doc = values[order], doc[order]
        new = np.append(True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1]))
        first = np.flatnonzero(new[: len(values)])
        sides.append((doc[first], values[first], np.diff(np.append(first, len(values)))))
    n, n_left = len(left), len(sides[0][0])
    doc, value, count = (np.concatenate(x) for x in zip(*sides))
    of_left = np.arange(len(doc)) < n_left
    order = np.lexsort((value, doc))
    doc, value, count, of_left = doc[order], value[order], count[order], of_left[order]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))[: len(value)]
    first = np.flatnonzero(new)
    doc, value = doc[first], value[first]
    if len(first):
        a = np.add.reduceat(np.where(of_left, count, 0), first)
        b = np.add.reduceat(np.where(of_left, 0, count), first)
    else:
        a = b = count
    common = np.bincount(doc, np.minimum(a, b), n)
    total = np.bincount(doc, np.maximum(a, b), n)
    more = np.maximum(a - b, 0)
    return {
        "similarity": common / np.maximum(total, 1),
        "common": common.astype(np.int64),
        "left_size": np.bincount(doc, a, n).astype(np.int64),
        "right_size": np.bincount(doc, b, n).astype(np.int64),
        "rest": np.repeat(value, more),
        "rest_counts": np.bincount(doc, more, n).astype(np.int64),
    }
