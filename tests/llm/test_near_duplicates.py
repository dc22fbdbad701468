import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadlake.llm import bagminhash
from threadlake.llm import near_duplicates as nd
from threadlake.scratch import Scratch


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0)))


def similarity(a, b):
    x, y = bag(a), bag(b)
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 0.0


def prose(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def brute_classes(rows):
    """Smallest id by class, over all pairs."""
    parent = {t: t for _, t in rows if bag(t)}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    texts = list(parent)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if root(a) != root(b) and similarity(a, b) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        if bag(t):
            least[root(t)] = min(i, least.get(root(t), i))
    return {i: least[root(t)] if bag(t) else i for i, t in rows}


def test_words_and_bags_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(bagminhash, "_BLOCK", 64)  # many block borders
    rng = random.Random(1)
    texts = ["", " ", "one", "a b c d", " é  ü\tx\n" * 9, "x" * 300 + " y", "a b " * 100]
    texts += ["".join(rng.choice("ab \n é") for _ in range(rng.randrange(90))) for _ in range(200)]
    hashes, counts = bagminhash.word_hashes(pa.array(texts))
    words = [t.encode().split() for t in texts]
    assert counts.tolist() == list(map(len, words))
    known = {}
    for h, w in zip(hashes.tolist(), (w for ws in words for w in ws)):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    doc, _, weight = bagminhash.bags(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(weight[doc == i]) == sorted(bag(t).values())


def test_memory_beside_a_batch_is_bounded():
    rng = random.Random(4)
    texts = pa.array([" ".join(prose(rng, 500)) for _ in range(5000)])  # 12 MB
    pairs = pa.RecordBatch.from_arrays([texts] * 4, names=["a", "b", "text_a", "text_b"])
    for work, most in (
        (lambda: bagminhash.bands(texts, 20, 5), 70e6),
        (lambda: [None for _ in nd._compare(True)(iter([pairs]))], 110e6),
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, peak


def test_words_longer_than_many_blocks(monkeypatch):
    texts = pa.array(["a b", "x" * 1000 + " y " + "z" * 999, "q" * 500, " " * 300 + "k"])
    want = bagminhash.word_hashes(texts)
    monkeypatch.setattr(bagminhash, "_BLOCK", 16)
    found = bagminhash.word_hashes(texts)
    assert found[0].tolist() == want[0].tolist() and found[1].tolist() == want[1].tolist() == [2, 3, 1, 1]


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(prose(rng, n)) for n in (1, 3, 5, 8, 80, 400, 2000)] + ["a b c d e " * 500]
    whole, _ = bagminhash.bands(pa.array(texts), 20, 5)
    for i, t in enumerate(texts):
        alone, has = bagminhash.bands(pa.array([t]), 20, 5)
        assert has.all() and (alone[0] == whole[i]).all()


@pytest.mark.parametrize("repeats", [1, 6, 40])
def test_signatures_estimate_weighted_similarity_without_bias(repeats):
    """``repeats`` makes counts of one shingle differ, so that weights matter."""
    rng = random.Random(repeats)
    off = []
    for _ in range(25):
        base = prose(rng, 60)
        a = base * repeats + prose(rng, 20)
        b = base * rng.randrange(1, repeats + 1) + prose(rng, 20)
        a, b = " ".join(a), " ".join(b)
        values, _ = bagminhash.signatures(pa.array([a, b]), 1000)
        off.append((values[0] == values[1]).mean() - similarity(a, b))
    assert abs(np.mean(off)) < 0.012 and np.abs(off).max() < 0.07


def test_comparison_equals_plain_one():
    rng = random.Random(3)
    left, right = [], []
    for _ in range(60):
        a = prose(rng, rng.randrange(0, 30)) * rng.randrange(1, 4)
        b = a[: rng.randrange(0, len(a) + 1)] + prose(rng, rng.randrange(0, 12))
        left.append(" ".join(a))
        right.append(" ".join(b))
    found = bagminhash.compare(pa.array(left), pa.array(right))
    for i, (a, b) in enumerate(zip(left, right)):
        assert abs(found["similarity"][i] - similarity(a, b)) < 1e-12
        assert found["common"][i] == sum((bag(a) & bag(b)).values())
        assert found["left_size"][i] == sum(bag(a).values())
        assert found["rest_counts"][i] == sum((bag(a) - bag(b)).values())


@pytest.mark.parametrize("edges_per_task", [nd.EDGES_PER_TASK, 20])
def test_components(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(nd, "EDGES_PER_TASK", edges_per_task)
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)]
    star = [("a", f"s{i}") for i in range(50)]
    loose = [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(50)]
    edges = chain + star + loose
    rng.shuffle(edges)
    found = nd.components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t"))
    found = {r.node: r.component for r in found.collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("few", [nd.FEW_PAIRS, 0])  # 0: members get hubs of their own until none helps
def test_classes_equal_all_pairs(spark, documents, monkeypatch, few):
    """Copies, near copies of near copies, families around a text that is not there, and noise."""
    monkeypatch.setattr(nd, "FEW_PAIRS", few)
    rng = random.Random(5)
    rows = []

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return words

    for family in range(3):
        base = prose(rng, 150)
        for i in range(40):
            rows.append(" ".join(changed(base, rng.randrange(0, 10))))
        step = base
        for i in range(12):
            step = changed(step, 2)
            rows.append(" ".join(step))
            rows.append(" ".join(step[: rng.randrange(110, 151)]))
    rows += [rows[7]] * 30 + [" ".join(prose(rng, 60)) for _ in range(60)]
    rows += ["a", "a", "a b", "a b c d", "", "", None, " \n", "same words " * 300]
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    docs = documents(numbered).withColumnRenamed("source", "Class_ID").withColumnRenamed("lang", "key")
    found = nd.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(numbered)
    assert len(found) == len(rows)


def test_repeated_and_null_ids_and_no_rows(spark, documents):
    text = " ".join(prose(random.Random(6), 40))
    docs = documents([(5, text), (5, text), (None, text), (9, text + " more"), (None, None), (7, "other")])
    found = sorted((r.doc_id or 0, r.class_id or 0) for r in nd.near_duplicates(docs, Scratch(spark, "t")).collect())
    assert found == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
    assert nd.near_duplicates(documents([]), Scratch(spark, "t")).count() == 0
