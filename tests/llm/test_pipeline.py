import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from threadlake.llm import language, packing, pii, quality
from test_near_duplicates import brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = {"aa": "river stone candle window garden".split(), "bb": "ñuo çevi übal élan öder".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)) + "."


def rows():
    rng = random.Random(1)
    out = [(i, prose(rng, "ab"[i % 2] * 2, 90), "ab"[i % 2] * 2, f"s{i % 5}") for i in range(120)]
    out += [(200 + i, out[i][1] + " end", out[i][2], "s1") for i in range(20)]
    out += [(300 + i, out[i][1] + f" mail{i}@host.example", "aa", "s2") for i in range(0, 10, 2)]
    out += [(400 + i, "%%% ".join(prose(rng, "aa", 80).split()), "aa", "s3") for i in range(6)]
    out += [(500, None, "aa", "s1"), (501, "", None, None), (502, "12 34 " * 40, "bb", "s1"), (0, *out[0][1:])]
    return out


def test_stages_equal_their_operators_one_by_one(spark, documents):
    docs = documents(rows())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "near_duplicates", "personal_data", "packing"]

    known = stages["language"](spark, docs, "").toArrow()
    assert known.column_names == COLUMNS
    learnt = docs.where(~language.held_out())
    model = language.fit(learnt)
    least = language.least_score(learnt, model)
    right = [r.score for r in language.identify(learnt, model).collect() if r.lang_pred == r.lang]
    assert least == min(right) > 0
    want = [
        r.doc_id
        for r in language.identify(docs, model).collect()
        if r.lang_pred != "und" and r.score >= least
    ]
    assert sorted(known["doc_id"].to_pylist()) == sorted(want)
    assert not {500, 501, 502} & set(want) and len(want) >= 150

    docs = spark.createDataFrame(known)
    good = stages["quality"](spark, docs, "").toArrow()
    counts = [quality.count_text(r.text)[:5] for r in docs.collect()]
    base = [r.doc_id for r, c in zip(docs.collect(), counts) if c[0] < 50 or 2 * c[4] > c[0]]
    kept = good["doc_id"].to_pylist()
    assert not set(kept) & (set(range(400, 406)) | set(base))
    assert set(kept) >= set(want) - set(range(400, 406)) - set(base)

    docs = spark.createDataFrame(good)
    single = stages["near_duplicates"](spark, docs, "").toArrow()
    classes = brute_classes([(i, t) for i, t in enumerate(good["text"].to_pylist())])
    by_text = dict(zip(good["text"].to_pylist(), classes.values()))
    left = [by_text[t] for t in single["text"].to_pylist()]
    assert sorted(left) == sorted(set(classes.values()))

    docs = spark.createDataFrame(single)
    clean = stages["personal_data"](spark, docs, "").toArrow().to_pylist()
    before = {r["doc_id"]: r["text"] for r in single.to_pylist()}
    assert len(clean) == len(before)
    for r in clean:
        assert r["text"] == pii.sanitise_text(before[r["doc_id"]], pii.base_spans(before[r["doc_id"]]), set())
        assert r["n_chars"] == len(r["text"])

    docs = spark.createDataFrame(clean, docs.schema)
    bins = defaultdict(list)
    for r in stages["packing"](spark, docs, "").collect():
        bins[r.bin_id].append(r)
    source = {r["doc_id"]: r["source"] for r in clean}
    for pieces in bins.values():
        assert sum(p.length for p in pieces) <= packing.CAPACITY
        assert len({source[p.doc_id] for p in pieces}) == len(pieces)
    assert {p.doc_id for b in bins.values() for p in b} == set(source)


def test_whole_run_and_clashing_columns(spark, documents, tmp_path):
    docs = documents(rows()).selectExpr("*", "1 as n_words", "'x' as score", "2 as _row", "3 as Spans", "4 as quality")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    documents(rows()).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 100 <= len({r.doc_id for r in out}) <= 130
    assert np.all([r.length > 0 for r in out])


def test_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
