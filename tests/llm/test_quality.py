import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, again, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\x1c\xa0#|😀", max_size=60))
def test_counts_equal_brute_force(text):
    assert quality.count_text(text)[:5] == brute(text)


def test_counts_of_unusual_texts():
    for text in (None, "", " \n ", "a", "a b c " * 5000, "x" * 200_000):
        assert quality.count_text(text)[:5] == brute(text)


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(n)]
    return " ".join(words) + "."


def test_junk_of_several_kinds_goes_and_prose_stays(documents):
    good = [(i, prose(i)) for i in range(80)]
    symbols = [(100 + i, "%%% ".join(prose(i).split()) + "###") for i in range(8)]
    shouting = [(200 + i, (prose(i, 20).upper() + "!! ") * 6) for i in range(8)]
    docs = documents([*good, *symbols, *shouting, (300, None), (301, ""), (302, "few words")])
    counted = quality.with_counts(docs)
    rows = quality.judge(counted, quality.fit(counted)).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(80))
    assert {r.doc_id for r in rows if r.base_failed} >= {300, 301, 302}


def test_extra_columns_repeated_rows_and_empty_tables(documents):
    docs = documents([(1, prose(1)), (1, prose(1)), (None, None)])
    docs = docs.withColumnRenamed("n_chars", "N_Words").withColumnRenamed("source", "quality")
    counted = quality.with_counts(docs)
    out = quality.judge(counted, quality.fit(counted))
    assert out.columns.count("quality") == 1 and "N_Words" not in out.columns
    assert [(r.doc_id, r.n_words) for r in out.orderBy("doc_id").collect()] == [
        (None, 0),
        (1, 120),
        (1, 120),
    ]
    none = quality.with_counts(documents([]))
    assert quality.judge(none, quality.fit(none)).count() == 0


def test_em_finds_the_accuracies_that_made_the_votes():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), len(quality.RULES)), int)
    for j in range(votes.shape[1]):
        right = rng.random(len(good)) < 0.75 + 0.02 * j
        votes[:, j] = np.where(rng.random(len(good)) < 0.3, 0, np.where(right == good, 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    for j, found in enumerate(model.accuracies().values()):
        assert abs(found - 0.75 - 0.02 * j) < 0.02
