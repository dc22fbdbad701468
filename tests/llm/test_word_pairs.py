"""Restaurants of whole words above those of endings, as op11 has them."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from threadlake.llm import word_model
from threadlake.llm.queries import op11_pitman_yor
from threadlake.llm.word_model import Settings
from threadlake.scratch import Scratch


def learns(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def learns_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


def made_texts(n, seed=3):
    """Words that follow one another by a rule which their endings do not show."""
    rnd = random.Random(seed)
    after = {i: rnd.sample(range(60), 4) for i in range(60)}
    rows = []
    for i in range(n):
        at, words = rnd.randrange(60), []
        for _ in range(rnd.randrange(1, 50)):
            at = rnd.choice(after[at])
            words.append(f"w{at}xa" if rnd.random() < 0.9 else f"{rnd.randrange(400)}b")
        rows.append((i, " ".join(words)))
    return rows


def scored(spark, documents, rows, **settings):
    df = documents(rows).select("doc_id", "text")
    settings = Settings(whole=True, **settings)
    found = word_model.score(df, learns_column(), Scratch(spark, "test"), settings=settings).collect()
    return {r.doc_id: r for r in found}


def pairs_of(text):
    tokens = (text or "").split() + [" "]
    return list(zip([""] + tokens[:-1], tokens))


def hash_of(word):
    return xxhash.xxh3_64_intdigest(word.encode())


def code_of(word):
    last = word.encode()[-2:]
    return hash_of(word) >> 16 << 16 | last[-1] << 8 | (last[0] if len(last) > 1 else 0) if word else 0


def unpacked(row):
    return {k: word_model._unpack(pa.scalar(bytes(row[k]))) for k in row.asDict() if k != "bucket"}


def plain_scores(fitted, totals, rows):
    """Pair by pair, from counts of the texts and the tables of repeated pairs."""
    counts = Counter(p for i, text in rows if learns(i) for p in pairs_of(text))
    words = Counter()
    for (_, w), c in counts.items():
        words[w] += c
    f = unpacked(fitted)
    place = {h: i for i, h in enumerate(f["words"].view(np.uint64).tolist())}
    word = np.repeat(np.arange(len(f["words"])), f["pairs"])
    live = np.repeat(word, f["lives"]).tolist()
    codes = f["asked"].view(np.uint64)[f["live_at"]].tolist()
    at = {pair: i for i, pair in enumerate(zip(live, codes))}
    tables3 = f["sample3"].reshape(len(totals), -1)
    own2 = {pair: i for i, pair in enumerate(zip(word.tolist(), f["ending"].tolist()))}
    tables2 = f["sample2"].reshape(len(totals), -1)
    first = lambda w, e: sorted(p for p in own2 if p[0] == w and p[1] >> 8 == e >> 8)
    letters = sorted({(w, e >> 8) for w, e in own2})
    tables1 = f["sample1"].reshape(len(totals), -1)
    tables0 = f["sample0"].reshape(len(totals), -1)
    chances = []
    for s, t in enumerate(totals):
        tables = {p: int(tables3[s][at[place[hash_of(p[1])], code_of(p[0])]]) if c > 1 else 1 for p, c in counts.items()}
        known, seated = Counter(), Counter()
        below2 = Counter()
        for (u, w), c in counts.items():
            known[u] += tables[u, w]
            seated[u] += c
            below2[place[hash_of(w)], code_of(u) & 65535] += tables[u, w]
        below1, below0 = Counter(), Counter()
        for (w, e), i in own2.items():
            below1[w, e >> 8] += int(tables2[s][i])
        for (w, e), n in zip(letters, tables1[s].tolist()):
            below0[w] += n
        assert sum(below2.values()) == t.customers[2].sum() and sum(below1.values()) == t.customers[1].sum()

        def chance(u, w, s=s, t=t, tables=tables, known=known, seated=seated, below2=below2, below1=below1, below0=below0):
            i, e = place.get(hash_of(w), -1), code_of(u) & 65535
            levels = [
                (0, 0, below0[i], int(tables0[s][i]) if i >= 0 else 0),
                (1, e >> 8, below1[i, e >> 8], int(tables1[s][letters.index((i, e >> 8))]) if (i, e >> 8) in below1 else 0),
                (2, e, below2[i, e], int(tables2[s][own2[i, e]]) if (i, e) in own2 else 0),
            ]
            p = 1 / (t.v + 1)
            for level, r, c, n in levels:
                d = t.discount[level]
                p = (c - d * n + (t.strength + d * t.tables[level][r]) * p) / (t.strength + t.customers[level][r])
            d = t.discount[3]
            c, n = (counts[u, w], tables[u, w]) if (u, w) in counts else (0, 0)
            return (c - d * n + (t.strength + d * known[u]) * p) / (t.strength + seated[u])

        chances.append(chance)
    mean = lambda u, w: sum(c(u, w) for c in chances) / len(chances)
    assert words.total() == totals[0].n and len(words) == totals[0].v
    return mean, words


def test_scores_against_the_plain_version_and_probabilities_sum_to_one(spark, documents):
    rows = made_texts(90) + [(900, None), (901, "new words only"), (902, "w1xa w1xa"), (903, ""), (904, "w1xa new")]
    given = documents(rows).select(learns_column().alias("learns"), F.coalesce("text", F.lit("")).alias("text"))
    settings = Settings(whole=True, here=0)
    state, totals, often = word_model.fit(given, Scratch(spark, "test"), settings, 1)
    (fitted,) = state.collect()
    assert len(totals) == settings.samples and len(often.keys) == 0
    mean, words = plain_scores(fitted, totals, rows)
    cache = {}
    found = scored(spark, documents, rows, here=0)
    for doc_id, text in rows:
        want = sum(math.log10(cache.setdefault(p, mean(*p))) for p in pairs_of(text))
        assert found[doc_id].score == pytest.approx(want, rel=1e-9)
        base = sum(math.log10((words[w] + 1) / (totals[0].n + totals[0].v + 1)) for _, w in pairs_of(text))
        assert found[doc_id].base_score == pytest.approx(base, rel=1e-9)
        assert found[doc_id].n_known == sum(w in words for _, w in pairs_of(text))
        assert found[doc_id].held_out == (not learns(doc_id))
    for before in ("", "w1xa", "w2xa", "never", "7b"):
        assert sum(mean(before, w) for w in words) + mean(before, "unheard") == pytest.approx(1, abs=1e-9)


def test_frequent_pairs_chunks_and_batches_change_nothing(spark, documents):
    rows = made_texts(80)
    for more in ({}, {"bucket_bytes": 2000}):
        whole = scored(spark, documents, rows, **more)
        for other in ({"here": 0}, {"chunk_bytes": 1000}):
            found = scored(spark, documents, rows, **more, **other)
            assert found.keys() == whole.keys()
            for doc_id, r in found.items():
                assert tuple(r) == pytest.approx(tuple(whole[doc_id]), rel=1e-9)


def test_a_hot_word_and_folding_count_every_pair(spark, documents, monkeypatch):
    rows = [(i, " ".join(f"the {i % 40}k{j}" for j in range(60))) for i in range(120)]
    given = documents(rows).select(F.lit(True).alias("learns"), "text")
    state, totals, _ = word_model.fit(given, Scratch(spark, "test"), Settings(whole=True, chunk_bytes=2000), 3)
    counts = Counter(p for _, text in rows for p in pairs_of(text))
    assert totals[0].n == sum(counts.values())
    rows = [unpacked(r) for r in state.collect()]
    assert sum(r["count"].sum() for r in rows) == totals[0].n
    assert sum(len(r["count3"]) for r in rows) == sum(c > 1 for c in counts.values())
    seated = defaultdict(int)
    for (u, _), c in counts.items():
        seated[code_of(u)] += c
    for r in rows:
        for code, n in zip(r["asked"].view(np.uint64).tolist(), r["customers"]):
            assert seated[code] == n


@pytest.mark.parametrize("values", [[], [0], [3, 200], [70_000, 1], [-1, 5], [1 << 40], [0.5, -2.0]])
def test_packed_values_come_back(values):
    values = np.array(values)
    found = word_model._unpack(pa.scalar(word_model._pack(values)))
    assert found.tolist() == values.tolist()


def test_nothing_to_learn_from_and_an_empty_table(spark, documents):
    ids = [i for i in range(50) if not learns(i)]
    for r in scored(spark, documents, [(i, "some words") for i in ids]).values():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert scored(spark, documents, []) == {}


def test_op11_knows_the_whole_word_before(spark, documents, tmp_path):
    """All words end alike: endings alone would score any order of them the same."""
    rows = [(i, " ".join(f"{w}xx" for w in text.replace("b", "").replace("xa", "").split())) for i, text in made_texts(400)]
    mixed = [(i + 1000, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in rows if not learns(i)]
    mixed = [r for r in mixed if not learns(r[0])]
    assert len(mixed) > 3
    documents(rows + mixed).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op11_pitman_yor(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) + len(mixed)
    right, wrong = (sum(found[i - k].score for i, _ in mixed) for k in (1000, 0))
    assert right > wrong + 0.1 * sum(found[i].n_tokens for i, _ in mixed)


def test_frequent_pairs_are_found_by_their_first_bits():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    near = keys ^ np.uint64(1)  # the same first bits
    wanted = np.concatenate([keys[::7], near, rng.integers(0, 1 << 64, 5000, dtype=np.uint64), keys[-1:]])
    for some in (keys, keys[:1], keys[:0]):
        place = {k: i for i, k in enumerate(some.tolist())}
        found = word_model._Often(some, some, some).finder()(wanted)
        assert found.tolist() == [place.get(k, -1) for k in wanted.tolist()]
