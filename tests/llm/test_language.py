import dataclasses
import zlib

import numpy as np
import pyarrow as pa
import pytest

from threadlake.llm import language

QUICK = dataclasses.replace(language.Settings(), steps=60, documents_per_language=60)


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


ALPHABETS = {"aa": "abcdefg ", "bb": "hijklmné", "cc": "opqrstuß"}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    return [
        (i, words(rng, ALPHABETS[lang], int(rng.integers(1, 120))), lang)
        for i, lang in enumerate(list(ALPHABETS) * 80)
    ]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    weights = {
        "byte": rng.normal(0, 0.5, (2, 9, 256)),
        "state": rng.normal(0, 0.5, (2, 9, 3)),
        "output": rng.normal(0, 0.5, (4, 6)),
        "bias": rng.normal(0, 0.5, 4),
    }
    x, y = rng.integers(97, 101, (7, 5)), np.array([0, 1, 2, 3, 1])
    _, grads = language._loss_and_gradients(weights, x, y)
    for name, at in (("byte", (0, 1, 98)), ("byte", (1, 8, 99)), ("state", (0, 4, 2)), ("state", (1, 7, 0)),
                     ("output", (2, 5)), ("bias", (3,))):
        step, change = 1e-3, {}
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += sign * step
            change[sign] = language._loss_and_gradients(moved, x, y)[0]
        wanted = (change[1] - change[-1]) / (2 * step)
        assert abs(wanted - grads[name][at]) < 1e-4 + 0.02 * abs(wanted)


def test_windows_cover_every_position_once():
    rng = np.random.default_rng(2)
    model = language.train([("aa", b"abc"), ("bb", b"hij")], dataclasses.replace(QUICK, steps=2))
    texts = ["", "a", "a" * 95, "ab" * 48, "abc" * 100, words(rng, "abchijé", 500)]
    got = language.document_probabilities(model, pa.array(texts), side_by_side=3)
    for text, p in zip(texts, got):
        data = np.frombuffer(text.encode(), np.uint8)
        total, n, w = np.zeros(2), len(data), model.window
        for start in range(0, n, w):
            begin = min(start, max(n - w, 0))
            window = np.full(w, 32, np.uint8)
            window[: min(w, n - begin)] = data[begin : begin + w]
            each = language.label_positions(model, window[:, None])[:, :, 0]
            total += each[start - begin : min(n, start + w) - begin].sum(axis=0)
        assert np.allclose(p, total / max(n, 1), atol=1e-4)


def test_held_out_accuracy_and_unusual_rows(spark, documents, rows):
    extra = [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, "", None), (None, "abc abc", "aa")]
    extra += [rows[0], rows[0], (1003, "hij " * 60_000, None)]
    docs = documents([*rows, *extra]).withColumnRenamed("source", "Score")
    learn = docs.where(~language.held_out())
    out = language.identify(docs, language.fit(learn, QUICK)).withColumn("out", language.held_out())
    got = out.collect()
    assert len(got) == len(rows) + len(extra) and out.columns.count("score") == 1
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and r.out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.out for r in got if r.doc_id)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert by_id[1000].score == 0 and by_id[1003].lang_pred == "bb" and by_id[None].out
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "abc", None), (2, None, "aa")])
    assert [r.lang_pred for r in language.identify(docs, language.fit(docs)).collect()] == ["und"] * 2
    none = documents([])
    assert language.identify(none, language.fit(none)).count() == 0
    one = documents([(1, "abc", "aa"), (2, "xyz", None)])
    assert {(r.lang_pred, r.score) for r in language.identify(one, language.fit(one)).collect()} == {("aa", 1.0)}


def test_sample_is_bounded(documents, rows):
    docs = documents([(i, "abc " * 100, "aa") for i in range(4000)] + rows)
    few = dataclasses.replace(QUICK, documents_per_language=50)
    sample = language.sample_windows(docs, few)
    assert len(sample) < 2 * 4 * 50 * 3 and all(len(w) <= few.window for _, w in sample)
    assert sample == language.sample_windows(docs.repartition(3), few)


def test_the_least_score_counts_all_labelled_documents(documents, rows):
    """Far more than the training sample holds: the lowest score lies outside it."""
    model = language.train([("aa", b"abcdefg abc"), ("bb", b"hijklmn hij")], QUICK)
    docs = documents([(i, "abc def " * 6, "aa") for i in range(8000)] + [(9001, "a", "aa"), (9002, "aah", "aa"), (9003, "1", "aa")])
    scores = [r.score for r in language.identify(docs, model).collect() if r.lang_pred == r.lang]
    assert language.least_score(docs, model) == min(scores) < max(scores)
    for few in (docs.where("doc_id < 9001"), docs.where("doc_id >= 9002")):
        assert language.least_score(few, model) >= min(scores)
    assert language.least_score(docs.where("doc_id = 9003"), model) == 0.0
