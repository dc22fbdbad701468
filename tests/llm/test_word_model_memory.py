"""What a Python worker of the word model holds does not grow with the number of chunks."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadlake.llm import word_model


def texts(n, seed):
    rnd = random.Random(seed)
    return [" ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(400)) for _ in range(n)]


def test_no_batch_is_held_while_the_next_one_is_read():
    held = []

    def batches():
        base = pa.total_allocated_bytes()
        for seed in range(4):
            held.append(pa.total_allocated_bytes() - base)
            batch = pa.RecordBatch.from_arrays([pa.array(texts(500, seed)), pa.array([True] * 500)], ["text", "learns"])
            size = batch.nbytes
            yield batch
            del batch
        assert size > 600_000

    rows = [r.num_rows for r in word_model._counting(1, 1 << 18)(batches())]
    assert len(rows) > 8 and max(held) < 100_000


def counted_rows(chunks):
    """Rows of one bucket, as many chunks bring them, made one by one."""
    run = word_model._counting(1, 1 << 22)
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array(texts(60, i % 5)), pa.array([True] * 60)], ["text", "learns"])
    made = [next(run(iter([batch(i)]))) for i in range(5)]
    for i in range(chunks):
        b = made[i % 5]
        yield pa.RecordBatch.from_arrays([pc.add(b.column(0), 0), *b.columns[1:]], names=b.schema.names)


def merged_peak(chunks, monkeypatch):
    monkeypatch.setattr(word_model, "_FOLD", 1 << 16)
    rows = counted_rows(chunks)
    first = next(rows)
    tracemalloc.start()
    out = list(word_model._merging(b for part in ([first], rows) for b in part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_merging_a_bucket_holds_its_words_not_its_chunks(monkeypatch):
    (few,), small = merged_peak(50, monkeypatch)
    (many,), large = merged_peak(1000, monkeypatch)
    assert large < 2 * small
    for name in ("words", "pairs", "ending"):
        assert few[name].equals(many[name])
    assert (20 * np.array(few["count"][0].values) == np.array(many["count"][0].values)).all()
