import hashlib
import random
import re

import pytest

from threadlake.llm import fill_middle
from threadlake.llm.fill_middle import Settings


def plain_version(doc_id, text, seed=7, rate=100, spm=50):
    """Lines by a loop, cuts by joins."""
    text = text or ""
    lines, rest = [], text
    while rest:
        end = rest.find("\n") + 1 or len(rest)
        lines.append(rest[:end])
        rest = rest[end:]
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def results(df, settings=Settings()):
    rows = fill_middle.rearrange(df, settings)
    rows = rows.withColumn("back", fill_middle.restore(settings=settings))
    return [(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in rows.collect()]


def test_against_the_plain_version(spark, documents):
    random.seed(3)
    alphabet = ["a", "é", "𝄞", "\n", "\n\n", "<", "<P", "S>", "\r\n", " ", "", "M"]
    rows = [(i, "".join(random.choices(alphabet, k=random.randrange(12)))) for i in range(300)]
    rows += [(i, "x\ny<M>\nz") for i in range(3)] + [(400, None), (None, "a\nb\nc"), (None, None), (-5, "\n")]
    rows += [(500, "line of a long text\n" * 60_000), (501, "x" * 900_000), (502, "a\n"), (502, "a\n")]
    seen = results(documents(rows))
    assert len(seen) == len(rows)
    forms = set()
    for doc_id, text, found, back in seen:
        assert found == plain_version(doc_id, text)
        assert back == (text or "")
        forms.add(found[1])
    assert forms == {"plain", "psm", "spm"}


def test_rates_and_seed(spark, documents):
    docs = documents([(i, "a\nb\nc\nd") for i in range(200)])
    settings = Settings(seed=11, rate=30, spm_rate=90)
    for doc_id, text, found, back in results(docs, settings):
        assert found == plain_version(doc_id, text, 11, 30, 90) and back == text


def test_units_that_leave_gaps_are_plain(spark, documents):
    settings = Settings(unit="[a-z]+ ")
    found = {d: f for d, _, f, _ in results(documents([(1, "ab cd ef "), (2, "ab cd ef")]), settings)}
    assert found[1][0] == 3 and found[1][1] != "plain"
    assert found[2] == (None, "plain", None, None, "ab cd ef")


def test_marks_must_be_told_apart():
    with pytest.raises(ValueError):
        Settings(prefix="<<")
    with pytest.raises(ValueError):
        Settings(prefix="<S>")


def test_empty_table_and_clashing_names(spark, documents):
    assert results(documents([])) == []
    docs = spark.createDataFrame([(1, "a\nb", "x", 5)], "doc_id int, text string, Form string, other int")
    row = fill_middle.rearrange(docs).collect()[0].asDict()
    assert row["form"] in ("psm", "spm") and row["other"] == 5 and "Form" not in row
