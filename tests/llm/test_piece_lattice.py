import os
import random
from functools import lru_cache

import pytest

from threadlake.llm import piece_lattice as pl

TEXTS = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "aa", "x"]
TOY = pl.Pieces(
    {p: 300 + i for i, p in enumerate(TEXTS)},
    {p: -float(3 + 7 * i % 11 + len(p)) for i, p in enumerate(TEXTS)},
    tuple(range(256)),
    tuple(bytes([i % 256]) for i in range(300)) + tuple(p.encode() for p in TEXTS),
)


def every_path(text):
    """All (score, ids) of a marked text, by plain recursion."""

    @lru_cache(None)
    def at(i):
        if i == len(text):
            return [(0.0, ())]
        out = []
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece in TOY.ids:
                step = (TOY.scores[piece], (TOY.ids[piece],))
            elif j == i + 1:
                step = (TOY.unknown, tuple(piece.encode()))
            else:
                continue
            out += [(step[0] + s, step[1] + ids) for s, ids in at(j)]
        return out

    return at(0)


@pytest.mark.parametrize("n_best", [1, 2, 3, 6])
def test_n_best_equals_all_paths(n_best):
    rng = random.Random(n_best)
    segmenter = pl.Segmenter(TOY, n_best)
    for _ in range(150):
        text = "".join(rng.choice("aabbc xé\n") for _ in range(rng.randrange(1, 9)))
        paths = every_path("▁" + text.replace(" ", "▁"))
        best = sorted((s for s, _ in paths), reverse=True)[:n_best]
        ids, score, others = pl.segment(segmenter, text)
        found = [(score, ids)] + [(o["score"], pl.apply_edits(ids, o["edits"])) for o in others]
        assert [round(s, 6) for s, _ in found] == [round(s, 6) for s in best]
        known = {(round(s, 6), i) for s, i in paths}
        assert len({tuple(i) for _, i in found}) == len(found)
        for s, i in found:
            assert (round(s, 6), tuple(i)) in known and pl.decode(TOY, i) == text


def test_one_part_by_a_star():
    for part in ("▁abca", "aabbcc", "xx", "é"):
        found = pl.Segmenter(TOY, 4).solve(part, 50)
        assert [s for s, _ in found] == sorted((s for s, _ in every_path(part)), reverse=True)[:50]


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["ab ca", "abc " * 40, "x é", "ab ca"]
    want = [pl.segment(pl.Segmenter(TOY, 3), t) for t in texts]
    monkeypatch.setattr(pl, "REMEMBERED", 1)
    segmenter = pl.Segmenter(TOY, 3)
    assert [pl.segment(segmenter, t) for t in texts] == want


@pytest.mark.skipif(not os.path.exists(pl.MODEL), reason="no public model here")
def test_public_model_on_documents(spark, documents):
    rows = [(1, "Hello world, größer\n\n  two  blanks"), (2, None), (3, ""), (4, "a" * 30_000), (5, "né 😀"), (1, " x ")]
    docs = documents(rows).withColumnRenamed("source", "Score")
    pieces = pl.load()
    out = pl.encode(docs, pieces).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    for r in out:
        if r.doc_id in (2, 3):
            assert (r.pieces, r.score, r.others) == ([], 0.0, [])
        else:
            assert len(r.others) == 2 and r.score >= r.others[0].score >= r.others[1].score
            for o in r.others:
                ids = pl.apply_edits(r.pieces, [e.asDict() for e in o.edits])
                assert ids != r.pieces and pl.decode(pieces, ids) == r.text
    assert pl.encode(documents([]), pieces).count() == 0
