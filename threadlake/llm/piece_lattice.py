"""N-best segmentation into the pieces of a public SentencePiece model, and decoding.

A text's lattice has an edge for every piece that matches at a place, with the piece's score from
the model file; a character that no piece covers has an edge of its own (as its bytes) with a score
below all others. A forward Viterbi pass gives the best score of every prefix. These scores are the
exact heuristic of an A* search that runs backwards from the end: paths come off its agenda in
order of their total score, best first.

Long texts stay cheap because the lattice falls apart wherever no piece holds two neighbouring
characters: every path passes such a place. The parts, mostly words, are solved one by one (and
remembered, up to a bound), and the same search runs over the row of parts. Among the n best paths of
the whole only the n - 1 parts with the least loss for their second-best path can differ from the
best one, so the row is searched over those. The texts of a batch are cut together, and each
different part is looked up once.

Text is taken as it is: blanks become the mark U+2581, one of which is put in front; nothing else
is normalised. Decoding reverses this, so every text without U+2581 comes back whole. A null or
empty text has no pieces, score 0 and no other segmentation. Ties are in a fixed order. Repeated
rows get equal results. Existing columns named like the output are replaced. The model is read on
the driver from a path that is a parameter, and sent to the executors: its size is fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heappop, heappush
from itertools import chain, pairwise
from math import inf
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlake.llm.frames import add_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000  # parts a worker keeps
_LONGEST_REMEMBERED = 48
BLOCK_CHARACTERS = 1 << 21  # texts cut together


@dataclass(frozen=True)
class Pieces:
    """The model's vocabulary: text and score of the normal pieces, ids of the byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes: tuple[int, ...]
    texts: tuple[bytes, ...]

    @cached_property
    def tree(self) -> dict:
        """The pieces by character: character -> (id or -1, score, what may follow)."""
        root: dict = {}
        for piece, number in sorted(self.ids.items()):
            node = root
            for c in piece[:-1]:
                node = node.setdefault(c, (-1, 0.0, {}))[2]
            below = node[piece[-1]][2] if piece[-1] in node else {}
            node[piece[-1]] = (number, self.scores[piece], below)
        return root

    @cached_property
    def unknown(self) -> float:
        return min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of every character, and which classes stand side by side in some piece."""
        characters = sorted({c for p in self.ids if len(p) > 1 for c in p})
        number = {c: i + 1 for i, c in enumerate(characters)}
        classes = np.zeros(0x110000, np.int64)
        for c, i in number.items():
            classes[ord(c)] = i
        pairs = np.zeros((len(characters) + 1,) * 2, bool)
        for p in self.ids:
            for a, b in pairwise(p):
                pairs[number[a], number[b]] = True
        return classes, pairs


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, texts, byte = {}, {}, [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            texts.append(piece.encode())
    return Pieces(ids, scores, tuple(byte), tuple(texts))


Path = tuple[float, tuple[int, ...]]


class Segmenter:
    """Solves parts and remembers their best paths under numbers, until it is told to forget."""

    def __init__(self, pieces: Pieces, n_best: int) -> None:
        self.pieces, self.n_best = pieces, n_best
        self.forget()

    def forget(self) -> None:
        self.ids: list[tuple[int, ...]] = []  # of the best path
        self.sums = np.zeros((1024, 2))  # its score, and what the second-best path loses
        self.numbers = _Numbers(self)

    def solve(self, part: str, n_best: int) -> list[Path]:
        """The best paths through one part: (score, ids), best first."""
        tree, unknown, n = self.pieces.tree, self.pieces.unknown, len(part)
        best = [-inf] * (n + 1)
        best[0] = 0.0
        edges: list[list] = [[] for _ in range(n + 1)]
        for start in range(n):
            base, below, single = best[start], tree, True
            for end in range(start, n):
                node = below.get(part[end])
                if node is None:
                    break
                number, score, below = node
                if number >= 0:
                    single = single and end > start
                    total = base + score
                    edges[end + 1].append((start, total, score, number))
                    if total > best[end + 1]:
                        best[end + 1] = total
                if not below:
                    break
            if single:  # no piece for the character itself
                total = base + unknown
                edges[start + 1].append((start, total, unknown, part[start]))
                if total > best[start + 1]:
                    best[start + 1] = total
        # Backwards: what an edge costs more than the best way to its end is all a path can lose.
        # Of equal losses the one nearest to the start goes first: ties are finished, not collected.
        agenda, found, count = [(0.0, n, 0, 0.0, None)], [], 0
        while agenda:
            loss, end, _, so_far, path = heappop(agenda)
            if not end:
                found.append((so_far, self._ids(path)))
                if len(found) == n_best:
                    break
                continue
            most = best[end] + loss
            for start, total, score, step in edges[end]:
                count += 1
                heappush(agenda, (most - total, start, count, so_far + score, (step, path)))
        return found

    def bytes_of(self, ids: tuple[int, ...]) -> bytes:
        return b"".join([self.pieces.texts[i] for i in ids])

    def _ids(self, path) -> tuple[int, ...]:
        out: list[int] = []
        while path is not None:
            step, path = path
            if isinstance(step, int):
                out.append(step)
            else:
                out.extend(self.pieces.bytes[b] for b in step.encode("utf-8", "surrogatepass"))
        return tuple(out)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Places between the code points of marked texts that every path passes."""
        classes, pairs = self.pieces.joined
        kinds = classes[points]
        joined = pairs.ravel().take(kinds[:-1] * len(pairs) + kinds[1:])
        return np.flatnonzero(~joined) + 1

    def others(
        self, part_at: Callable[[int], str], losses: np.ndarray
    ) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """The next best paths of a whole text: (loss, [(place of a part, its other ids)])."""
        wanted = self.n_best - 1
        if len(losses) > wanted > 0:
            places = np.sort(np.argpartition(losses, wanted - 1)[:wanted])
        else:
            places = np.arange(len(losses) if wanted > 0 else 0)
        rivals = [(int(p), self.solve(part_at(int(p)), self.n_best)) for p in places if losses[p] < inf]
        # Backwards over these parts; the best paths of the parts before cost nothing more.
        agenda, found, count = [(0.0, 0, len(rivals), ())], [], 0
        while agenda and len(found) <= wanted:
            loss, _, level, changes = heappop(agenda)
            if not level:
                found.append((loss, list(changes)))
                continue
            place, paths = rivals[level - 1]
            for number, (score, ids) in enumerate(paths):
                count += 1
                more = ((place, ids), *changes) if number else changes
                heappush(agenda, (loss + paths[0][0] - score, count, level - 1, more))
        return found[1:]


class _Numbers(dict):
    """Part to its number; unknown parts are solved."""

    def __init__(self, segmenter: Segmenter) -> None:
        self._segmenter = segmenter

    def __missing__(self, part: str) -> int:
        owner = self._segmenter
        found = owner.solve(part, 2)
        number = len(owner.ids)
        if number == len(owner.sums):
            owner.sums = np.concatenate([owner.sums, np.zeros_like(owner.sums)])
        score = found[0][0]
        owner.sums[number] = score, (score - found[1][0] if len(found) > 1 else inf)
        owner.ids.append(found[0][1])
        if len(part) <= _LONGEST_REMEMBERED:
            self[part] = number
        return number


class Block(NamedTuple):
    """Segmentations of some texts: ids of all one after another with the end of each text's, scores,
    the next best ones as changes to the best, and whether the pieces' bytes give the text."""

    ids: np.ndarray
    ends: np.ndarray
    scores: np.ndarray
    others: list[list[dict]]
    back: np.ndarray


def segment_all(segmenter: Segmenter, texts: list[str]) -> Block:
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    borders = np.append(0, np.cumsum([len(m) for m in marked]))
    inside = segmenter.cuts(points) if len(points) else np.zeros(0, np.int64)
    cut = np.zeros(len(points) + 1, bool)
    cut[borders] = cut[inside] = True
    cuts = np.flatnonzero(cut)
    size = np.ones(len(points), np.int8)  # bytes of each character
    for least in (0x80, 0x800, 0x10000):
        size += points >= least
    ends = np.append(0, np.cumsum(size, dtype=np.int64))[cuts]
    # The parts as an Arrow array over the texts' own bytes; Arrow finds the different ones.
    data = "".join(marked).encode()
    offsets = pa.py_buffer(ends.astype(np.int64))
    parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, offsets, pa.py_buffer(data)).dictionary_encode()
    distinct = parts.dictionary.to_pylist()
    code = np.asarray(parts.indices, np.int64)

    numbers = [segmenter.numbers[p] for p in distinct]
    best = [segmenter.ids[n] for n in numbers]
    sums = segmenter.sums[numbers].reshape(-1, 2)
    lengths = np.array([len(ids) for ids in best], np.int64)
    flat = np.fromiter(chain.from_iterable(best), np.int32, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    count = lengths[code]
    behind = np.append(0, np.cumsum(count))
    ids = flat[np.repeat(starts[code] - behind[:-1], count) + np.arange(behind[-1])]
    # Pieces' bytes give their part's bytes, and a text's bytes are those of its parts in order.
    same = np.array([segmenter.bytes_of(i) == p.encode() for i, p in zip(best, distinct)], bool)
    wrong = np.append(0, np.cumsum(~same[code]))

    first = np.searchsorted(cuts, borders)  # of the parts of each text
    scores, others, back = np.zeros(len(texts)), [], np.ones(len(texts), bool)
    for i, text in enumerate(texts):
        a, b = first[i], first[i + 1]
        if a == b:
            others.append([])
            continue
        mine = code[a:b]
        scores[i] = sums[mine, 0].sum()
        back[i] = wrong[a] == wrong[b] and SPACE not in text
        found = []
        for loss, changes in segmenter.others(lambda p: distinct[mine[p]], sums[mine, 1]):
            edits = [
                {"first": int(behind[a + p] - behind[a]), "length": int(count[a + p]), "pieces": list(new)}
                for p, new in changes
            ]
            found.append({"score": scores[i] - loss, "edits": edits})
        others.append(found)
    if len(segmenter.ids) > REMEMBERED:
        segmenter.forget()
    return Block(ids, behind[first[1:]], scores, others, back)


def segment(segmenter: Segmenter, text: str | None) -> tuple[list[int], float, list[dict]]:
    """Ids and score of the best path of one text, and the next best ones as changes to it."""
    block = segment_all(segmenter, [text or ""])
    return block.ids.tolist(), float(block.scores[0]), block.others[0]


def _pieces_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK_CHARACTERS`` together; a longer one comes alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > BLOCK_CHARACTERS:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def decode(pieces: Pieces, ids: list[int]) -> str:
    text = b"".join([pieces.texts[i] for i in ids]).decode("utf-8", "replace")
    return text.replace(SPACE, " ")[1:]


def apply_edits(ids: list[int], edits: list[dict]) -> list[int]:
    """The ids of another segmentation from those of the best one."""
    out = list(ids)
    for e in sorted(edits, key=lambda e: -e["first"]):
        out[e["first"] : e["first"] + e["length"]] = e["pieces"]
    return out


_OTHERS = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            (
                "edits",
                pa.list_(
                    pa.struct(
                        [("first", pa.int32()), ("length", pa.int32()), ("pieces", pa.list_(pa.int32()))]
                    )
                ),
            ),
        ]
    )
)
_OUTPUT_SCHEMA = pa.schema(
    [("pieces", pa.list_(pa.int32())), ("score", pa.float64()), ("others", _OTHERS), ("round_trip", pa.bool_())]
)
OUTPUT = (
    "pieces array<int>, score double, others array<struct<score:double,"
    "edits:array<struct<first:int,length:int,pieces:array<int>>>>>, round_trip boolean"
)

_SEGMENTERS: dict[int, Segmenter] = {}


def encode(
    docs: DataFrame,
    pieces: Pieces,
    text: str = "text",
    n_best: int = 3,
    keep_text: bool = True,
) -> DataFrame:
    """Add the best segmentation, the next best ones, and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(texts: pa.Array) -> list[pa.Array]:
        vocabulary = shared.value
        segmenter = _SEGMENTERS.get(n_best)
        if segmenter is None or segmenter.pieces is not vocabulary:
            segmenter = _SEGMENTERS[n_best] = Segmenter(vocabulary, n_best)
        values = [t or "" for t in texts.to_pylist()]
        blocks = [segment_all(segmenter, values[a:b]) for a, b in _pieces_of(values)]
        if not blocks:
            return [pa.array([], f.type) for f in _OUTPUT_SCHEMA]
        before = np.cumsum([0, *[len(b.ids) for b in blocks[:-1]]])
        ends = np.concatenate([[0], *[b.ends + n for b, n in zip(blocks, before)]])
        ids = np.concatenate([b.ids for b in blocks])
        return [
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
            pa.array(np.concatenate([b.scores for b in blocks])),
            pa.array(list(chain.from_iterable(b.others for b in blocks)), _OTHERS),
            pa.array(np.concatenate([b.back for b in blocks])),
        ]

    return add_columns(docs, run, [text], OUTPUT, () if keep_text else (text,))
