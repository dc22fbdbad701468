import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadlake.llm import word_model
from threadlake.llm.seating import Seats, Worth, adjusted, gibbs, seat
from threadlake.llm.word_model import Fitted, Settings
from threadlake.scratch import Scratch

def learns_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


BLANKS = " \t\n\x0b\x0c\r"


def learns(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def plain_tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.translate({ord(c): " " for c in BLANKS}).split(" ") if w] + [None]


def plain_base(rows):
    counts = Counter(t for doc_id, text in rows if learns(doc_id) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text in rows:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        yield doc_id, not learns(doc_id), len(tokens), sum(t in counts for t in tokens), n, pytest.approx(base, rel=1e-9)


def scored(spark, documents, rows, **settings):
    df = documents(rows).select("doc_id", "text")
    found = word_model.score(df, learns_column(), Scratch(spark, "test"), settings=Settings(**settings))
    return found.collect()


def made_texts(n, seed=5):
    """Words whose beginnings follow from the ending of the word before."""
    rnd = random.Random(seed)
    stems = {e: [f"{e}{a}{b}" for a in "kmst" for b in "aeo"] for e in "abcd"}
    rows = []
    for i in range(n):
        last, words = "a", []
        for _ in range(rnd.randrange(1, 60)):
            word = rnd.choice(stems[last]) + rnd.choice("abcd")
            if rnd.random() < 0.05:
                word = f"{rnd.randrange(500)}x{last}"
            last = word[-1] if word[-1] in "abcd" else "a"
            words.append(word)
        rows.append((i, " ".join(words)))
    return rows


def test_counts_and_base_against_the_plain_version(spark, documents):
    rnd = random.Random(2)
    words = ["the", "The", "ÉTÉ", "été", "x", "\x00", "İ", "a\x85b", "don't", "𝄞"]
    rows = [(i, rnd.choice(BLANKS).join(rnd.choices(words, k=rnd.randrange(20)))) for i in range(200)]
    rows += [(201, None), (202, ""), (203, " \n\t"), (204, "word " * 50_000), (205, "y" * 400_000)]
    rows += [(7, rows[7][1])] * 3 + [(None, "a null id"), (206, "\x0bThe\x0c ")]
    for more in ({}, {"chunk_bytes": 500, "bucket_bytes": 1 << 12}, {"here": 0}):
        found = [tuple(r)[:6] for r in scored(spark, documents, rows, **more)]
        key = lambda r: (str(r[0]), r[2])
        assert sorted(found, key=key) == sorted(plain_base(rows), key=key)


def plain_score(fitted, totals, text):
    """Token by token, from numbers of customers and tables in dictionaries."""
    places = {int(w): i for i, w in enumerate(fitted.words)}
    score, before = 0.0, b""
    for token in plain_tokens(text):
        code = b" " if token is None else token.encode()
        letters = before[-1:][0] if before else 0
        ending = letters * 256 + (before[-2] if len(before) > 1 else 0)
        place, mean = places.get(xxhash.xxh3_64_intdigest(code), -1), 0.0
        for s, t in enumerate(totals):
            p = 1 / (t.v + 1)
            for level, restaurant, key in ((0, 0, place), (1, letters, place * 256 + letters), (2, ending, place * 65536 + ending)):
                c_all, t_all = t.customers[level][restaurant], t.tables[level][restaurant]
                at = np.flatnonzero(fitted.keys[level] == key) if place >= 0 else []
                c, n = (fitted.customers[level][s][at[0]], fitted.tables[level][s][at[0]]) if len(at) else (0, 0)
                d = t.discount[level]
                p = (c - d * n) / (t.strength + c_all) + (t.strength + d * t_all) / (t.strength + c_all) * p
            mean += p / len(totals)
        score += math.log10(mean)
        before = code if token is not None else b""
    return score


def fitted_rows(state):
    rows = state.collect()
    arrays = lambda name: np.concatenate([np.array(r[name], np.int64) for r in rows])
    assert len(rows) == 1
    kept = [arrays(f"sample{level}") for level in range(3)]
    return Fitted.read(arrays("words").view(np.uint64), arrays("pairs"), arrays("ending"), arrays("count"), kept)


def test_scores_against_the_plain_version_and_probabilities_sum_to_one(spark, documents):
    rows = made_texts(80) + [(900, None), (901, "new words only"), (902, "Akaa akaA")]
    given = documents(rows).select(learns_column().alias("learns"), F.coalesce("text", F.lit("")).alias("text"))
    settings = Settings(here=0)
    state, totals, often = word_model.fit(given, Scratch(spark, "test"), settings, 1)
    fitted = fitted_rows(state)
    assert len(totals) == settings.samples and len(often.words) == 0
    found = {r.doc_id: r.score for r in scored(spark, documents, rows, here=0)}
    for doc_id, text in rows:
        assert found[doc_id] == pytest.approx(plain_score(fitted, totals, text), rel=1e-9)
    words = np.sort(np.append(fitted.words, np.uint64(12345)))  # and one for all unknown words
    for ending in (0, ord("a") * 256 + ord("a"), ord("b") * 256 + ord("o"), 77 * 256 + 5):
        _, logs = fitted.scores(words, np.arange(len(words)), np.full(len(words), ending), totals)
        assert (10**logs).sum() == pytest.approx(1, abs=1e-9)


def test_frequent_words_scored_in_place_change_nothing(spark, documents):
    rows = made_texts(60)
    for more in ({}, {"chunk_bytes": 2000, "bucket_bytes": 4000}):
        with_them = {r.doc_id: tuple(r) for r in scored(spark, documents, rows, **more)}
        without = {r.doc_id: tuple(r) for r in scored(spark, documents, rows, here=0, **more)}
        for doc_id in with_them:
            assert with_them[doc_id] == pytest.approx(without[doc_id], rel=1e-9)


def test_held_out_texts_are_predicted_better_than_by_counts_and_in_order(spark, documents):
    rows = made_texts(300)
    shuffled = [(i + 1000, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in rows]
    held = [r for r in rows if not learns(r[0])]
    mixed = [r for r in shuffled if not learns(r[0])]
    found = scored(spark, documents, [r for r in rows if learns(r[0])] + held + mixed)
    per_token = lambda some, of: sum(getattr(r, of) for r in some) / sum(r.n_tokens for r in some)
    right = [r for r in found if r.held_out and r.doc_id < 1000]
    wrong = [r for r in found if r.held_out and r.doc_id >= 1000]
    assert per_token(right, "score") > per_token(right, "base_score") + 0.1
    assert per_token(right, "score") > per_token(wrong, "score") + 0.1


def test_nothing_to_learn_from_and_an_empty_table(spark, documents):
    ids = [i for i in range(50) if not learns(i)]
    for r in scored(spark, documents, [(i, "some words") for i in ids]):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert scored(spark, documents, []) == []


def test_gibbs_reaches_the_exact_distribution():
    base, slope, d, n = 0.6, 0.25, 0.4, 60_000
    one, two = (1 - d), (1 - d) * (2 - d)
    weights = [base * two, 3 * base * (base + slope) * one, base * (base + slope) * (base + 2 * slope)]
    rng, customers = np.random.default_rng(3), np.full(n, 3)
    worth = Worth(np.full(n, base), np.full(n, slope))
    seats = seat(np.arange(n), customers, worth, d, rng)
    for _ in range(8):
        seats = gibbs(seats, customers, worth, d, 8, rng)
    assert (seats.customers(n) == 3).all()
    shares = np.bincount(seats.table_counts(n), minlength=4)[1:] / n
    assert shares == pytest.approx(np.array(weights) / sum(weights), abs=0.01)


def test_sections_gain_and_lose_customers():
    rng = np.random.default_rng(4)
    n = 500
    customers = rng.integers(0, 400, n)
    worth = Worth(np.full(n, 2.0), np.full(n, 0.1))
    seats = seat(np.arange(n), customers, worth, 0.7, rng)
    assert (seats.customers(n) == customers).all()
    for _ in range(3):
        customers = np.maximum(customers + rng.integers(-90, 90, n), 0)
        seats = adjusted(seats, customers, worth, 0.7, rng)
        assert (seats.customers(n) == customers).all()
        assert ((seats.table_counts(n) > 0) == (customers > 0)).all()


def table_chances(customers, base, slope, discount):
    """Exact chances of 1, 2, ... tables, customer by customer."""
    ways = np.array([1.0])
    for c in range(1, customers):
        tables = np.arange(1, c + 1)
        ways = np.append(ways * (c - discount * tables), 0) + np.append(0, ways * (base + slope * tables))
        ways /= ways.sum()
    return ways


@pytest.mark.parametrize(
    "customers, base, slope, discount",
    [(9, 1.0, 0.3, 0.5), (60, 20.0, 0.01, 0.8), (300, 2.0, 0.1, 0.7), (1500, 0.5, 0.2, 0.3)],
)
def test_a_sweep_moves_all_customers_of_large_sections(customers, base, slope, discount):
    """Of sections with all at one table; eight moves each would leave nearly all where they are."""
    n, rng, tables = 1500, np.random.default_rng(6), np.arange(1, customers + 1)
    worth, total = Worth(np.full(n, base), np.full(n, slope)), np.full(n, customers)
    seats = Seats(np.arange(n), total, np.ones(n, np.int64))
    for _ in range(5):
        seats = gibbs(seats, total, worth, discount, 8, rng)
    assert (seats.customers(n) == customers).all()
    chances, found = table_chances(customers, base, slope, discount), seats.table_counts(n)
    mean = chances @ tables
    spread = math.sqrt(chances @ tables**2 - mean**2)
    assert found.mean() == pytest.approx(mean, abs=0.15 * spread)
    assert found.std() == pytest.approx(spread, rel=0.12)


def test_a_section_of_a_billion_customers():
    rng, customers = np.random.default_rng(8), np.array([10**9])
    worth = Worth(np.array([40.0]), np.array([0.05]))
    seats = Seats(np.array([0]), customers, np.array([1]))
    for _ in range(3):
        seats = gibbs(seats, customers, worth, 0.6, 8, rng)
        assert seats.customers(1) == customers
    assert 30 < seats.table_counts(1)[0] < 120
