import random
from collections import defaultdict

from threadlake.llm import packing

SCHEMA = "doc_id bigint, size bigint, source string, cluster string, BIN_ID string"


def brute(sizes, sources, clusters, capacity):
    bins = []
    out = []
    for item in zip(sizes, sources, clusters):
        fits = [
            (capacity - sum(i[0] for i in b), n)
            for n, b in enumerate(bins)
            if capacity - sum(i[0] for i in b) >= item[0]
            and not any(
                (i[1] is not None and i[1] == item[1]) or (i[2] is not None and i[2] == item[2])
                for i in b
            )
        ]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((n, sum(i[0] for i in bins[n])))
        bins[n].append(item)
    return out


def test_search_equals_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randrange(0, 60)
        sizes = sorted((rng.randrange(0, 30) for _ in range(n)), reverse=True)
        sources = [rng.choice(["a", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        got = packing.best_fit(sizes, sources, clusters, 40)
        assert list(zip(*got)) == brute(sizes, sources, clusters, 40)


def test_whole_table(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice([0, 3, 40, 99, 100, 101, 250, 1000]), "hot" if i % 3 == 0 else f"s{i % 7}", f"c{i % 90}", "x")
        for i in range(400)
    ]
    rows += [(None, None, None, None, None), (7, 10, None, None, None), (7, 10, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack(docs, capacity=100, shard_documents=64).collect()
    lengths, bins = defaultdict(int), defaultdict(list)
    for r in out:
        lengths[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    want = defaultdict(int)
    for doc_id, size, *_ in rows:
        want[doc_id] += size or 0
    assert dict(lengths) == dict(want)
    source, cluster = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for pieces in bins.values():
        end = 0
        for r in sorted(pieces, key=lambda r: (r.bin_offset, r.length)):
            assert r.bin_offset == end
            end += r.length
        assert end <= 100
        for of in (source, cluster):
            named = [of[r.doc_id] for r in pieces if r.doc_id not in (None, 7)]
            assert len(named) == len(set(named))
    again = packing.pack(docs.repartition(5), capacity=100, shard_documents=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_repeated_rows_longer_than_a_bin(spark):
    rows = [(7, 250, "s", "c", "x")] * 300 + [(None, 200, "s", None, None)] * 20
    rows += [(None, 200, None, "s", None)] * 20
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=100, shard_documents=64).collect()
    assert sum(r.length for r in out) == 300 * 250 + 40 * 200
    assert len({r.bin_id for r in out}) == len(out) == 300 * 3 + 40 * 2
    shards = defaultdict(int)
    for r in out:
        shards[r.bin_id.removeprefix("f-").split("-")[0]] += r.piece == 0
    assert len(shards) == 6 and max(shards.values()) < 120


def test_no_rows_and_clusters(spark, documents):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = documents([(1, "A b, C!"), (2, "a  B c"), (3, "abd"), (4, None), (5, "?!")])
    keys = {r.doc_id: r.c for r in docs.select("doc_id", packing.cluster_of("text").alias("c")).collect()}
    assert keys[1] == keys[2] != keys[3] and keys[4] is None and keys[5] is None


def test_sizes_by_the_word_rule(spark, documents):
    rng = random.Random(7)
    blanks = " \t\n\x0b\x0c\r"
    texts = ["\na b\n", "\n", "\t", " \x0b", "", None, "a", "é x y", "a\x1cb c", "  z", "word " * 100_000]
    texts += ["".join(rng.choice(blanks + "abé \x85") for _ in range(rng.randrange(20))) for _ in range(200)]
    found = packing.with_sizes(documents(list(enumerate(texts)))).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        words = [w for w in text.translate({ord(b): " " for b in blanks}).split(" ") if w]
        assert r["size"] == len(words), text
    assert len(found) == len(texts)
