import duckdb

from threadlake.llm import chat
from threadlake.scratch import Scratch

SCHEMA = "conv_id bigint, turn bigint, role string, text string, Speaker string"


def rendered(spark, rows):
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return chat.rotate_perspectives(turns, Scratch(spark, "t"))


def test_every_speaker_is_once_the_assistant(spark):
    rows = [
        (1, 2, "ann", "hello <|end|> all"),
        (1, 1, "system", "be kind"),
        (1, 3, "bob", None),
        (1, 4, None, "who am I"),
        (1, 5, "ann", "é😀"),
        (2, 1, "system", "alone"),
        (None, 1, "ann", "nowhere"),
    ]
    out = rendered(spark, rows).orderBy("perspective", "position").collect()
    assert {r.perspective for r in out} == {"ann", "bob", "unknown"} and len(out) == 15
    ann = [r for r in out if r.perspective == "ann"]
    whole = "".join(r.rendered for r in ann)
    assert whole == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhello <​|end|> all<|end|>\n"
        "<|user:bob|>\n<|end|>\n<|user:unknown|>\nwho am I<|end|>\n<|assistant|>\né😀<|end|>\n"
    )
    for r in ann:
        assert whole[r.seq_start : r.seq_end] == r.rendered
    masked = [whole[r.mask_start : r.mask_end] for r in ann if r.mask_start is not None]
    assert masked == ["hello <​|end|> all<|end|>", "é😀<|end|>"]


def test_equals_its_sql_with_a_hot_dialogue_and_repeated_rows(spark):
    rows = [(7, i // 2, f"p{i % 3}", f"text {i // 2}") for i in range(3000)]
    rows += [(i, t, "ab"[t % 2], "x" * t) for i in range(200) for t in range(5)] + [(3, 1, "a", None)] * 3
    got = rendered(spark, rows)
    conversations = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).toArrow()  # noqa: F841
    names = ", ".join(got.columns)
    want = duckdb.sql(f"SELECT {names} FROM ({chat.SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_rows(spark):
    assert rendered(spark, []).count() == 0
