import math
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlake.llm import pii
from threadlake.scratch import Scratch

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    parts = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(p // 10 + p % 10 for p in parts) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits or "0"),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.-+%0159 ()é😀", max_size=50))
def test_patterns_equal_the_plain_search(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789 -", min_size=14, max_size=40))
def test_cards_equal_the_plain_search(text):
    assert pii.base_spans(text) == brute(text)


def test_known_values():
    text = "é a.b@c.de 4111 1111 1111 1111 +1 (386) 555-3733 or 10.0.0.255 10.0.0.256"
    assert [k for k, *_ in pii.base_spans(text)] == ["email", "card", "phone", "ip"]
    assert pii.base_spans(text) == brute(text)
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 500_000 + "@", "a@" * 200_000, "1" * 500_000, "1." * 250_000, "+1" + "(" * 500_000,
                 "a@b" + ".c" * 200_000 + "." * 100_000):
        pii.base_spans(text)
        pii.contexts(text, pii.Settings())
    assert time.time() - began < 20


def revealing_rows():
    """Zebulon stands beside one address in many surroundings; the other words do so elsewhere too."""
    rows = []
    for i in range(6):
        fill = " ".join(f"{c}{'abcdef'[i]}word" for c in "qrst")
        rows.append((i, f"{fill} common Zebulon writes zz@host.example common {fill} Zebulon."))
    rows += [(10 + i, f"common writes other{'xyz'[i % 3]} text of no one") for i in range(60)]
    return rows


def test_terms_that_reveal_an_entity(spark, documents):
    docs = documents(revealing_rows()).withColumnRenamed("source", "Spans")
    out = {r.doc_id: r for r in pii.sanitise(docs, Scratch(spark, "t")).collect()}
    assert [s.kind for s in out[0].spans] == ["term", "email", "term"]
    assert "Zebulon" not in out[0].sanitised and "<EMAIL>" in out[0].sanitised
    assert "common" in out[0].sanitised and "qaword" in out[0].sanitised
    assert all(not out[10 + i].spans and out[10 + i].sanitised == out[10 + i].text for i in range(60))


def test_copies_of_one_text_reveal_nothing(spark, documents):
    text = revealing_rows()[0][1]
    docs = documents([(i, text) for i in range(50)] + [(99, "plain words"), (None, None), (5, "")])
    rows = pii.sanitise(docs, Scratch(spark, "t")).collect()
    assert {s.kind for r in rows for s in r.spans} == {"email"} and len(rows) == 53
    assert [r.sanitised for r in rows if r.doc_id is None] == [None]
    assert pii.sanitise(documents([]), Scratch(spark, "t")).count() == 0


def test_name_beside_three_entities_of_many_documents(spark, documents):
    rows = []
    for i in range(12):
        a, b, c, d = (f"{x}{'abcdefghijkl'[i]}word" for x in "qrst")
        rows.append((i, f"{a} {b} Zebulon zz@host.example {c} +1 386 555 3733 {d} 10.0.0.7 {b} {a} {d}"))
    rows += [(100 + i, "plain words of no one") for i in range(188)]
    out = pii.sanitise(documents(rows), Scratch(spark, "t")).where("doc_id < 100").collect()
    assert len(out) == 12 and not any("Zebulon" in r.sanitised for r in out)
    assert all("<EMAIL>" in r.sanitised and "aword" in r.sanitised for r in out if r.doc_id == 0)


def unlike(i, n):
    """Words of a text that shares none with other numbers' texts."""
    return " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[i]}x{'abcdefghij'[j // 10]}{'abcdefghij'[j % 10]}" for j in range(n))


def test_fixed_signature_in_unrelated_texts(spark, documents):
    rows = [(i, f"{unlike(i, 40)} kind regards Jane Doe jane@host.example") for i in range(20)]
    rows += [(100 + i, "kind regards plain words of no one") for i in range(80)]
    out = {r.doc_id: r.sanitised for r in pii.sanitise(documents(rows), Scratch(spark, "t")).collect()}
    assert all(out[i].split()[-3:] == ["kind", "regards", "<EMAIL>"] for i in range(20))
    assert all(out[i].startswith(unlike(i, 40)) and "regards" in out[100 + i] for i in range(20))


def test_near_copies_reveal_nothing_but_surroundings_of_one_text_do(spark, documents):
    near = [(i, f"{unlike(0, 80)} {unlike(i + 1, 1)} Jane jane@host.example") for i in range(12)]
    one = " ".join(f"{unlike(20 + i, 30)} Zebulon zz@host.example" for i in range(3))
    rows = [*near, (50, one), *[(100 + i, "plain words of no one") for i in range(80)]]
    out = {r.doc_id: r.sanitised for r in pii.sanitise(documents(rows), Scratch(spark, "t")).collect()}
    assert all("Jane <EMAIL>" in out[i] for i in range(12))
    assert "Zebulon" not in out[50] and unlike(20, 30) in out[50]


def test_digest(spark, documents):
    docs = documents([(1, "x a@b.cd y"), (2, None)])
    found = pii.sanitise(docs, Scratch(spark, "t"))
    one, two = found.select("doc_id", *pii.digest(found)).orderBy("doc_id").collect()
    import hashlib

    assert (one.n_email, one.n_phone, one.spans) == (1, 0, "email:2:8")
    assert one.base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert two.base_sha256 == hashlib.sha256(b"").hexdigest() and two.spans == ""


def test_overlapping_spans_are_replaced_once():
    text = "call 4111111111111111 now"
    spans = pii.base_spans(text) + [("phone", 9, 24)]
    assert pii.sanitise_text(text, pii.in_order(spans), set()) == "call <CARD>w"


@pytest.mark.parametrize("share, shown", [(0.8, "<NAME>"), (0.99, "")])
def test_removed_or_generalised(share, shown):
    removed = {"bob"} if share >= pii.Settings().remove_at else set()
    assert pii.sanitise_text("hi Bob!", [("term", 3, 6)], removed) == f"hi {shown}!"


def test_levels_of_generalisation():
    for text, shown in (("hi bob!", "hi <WORD>!"), ("12 bob", "12 <MEASURE>"), ("hi bob 7", "hi <MEASURE> 7"), ("a Bob 7", "a <NAME> 7")):
        start = text.lower().index("bob")
        assert pii.sanitise_text(text, [("term", start, start + 3)], set()) == shown


def plain_shares(rows, chosen):
    """Largest share of each term that reveals an entity, counted in dictionaries. The texts are
    unlike each other, so each is a class of its own."""
    n, n_entity, n_both, n_term = len(rows), Counter(), Counter(), Counter()
    for _, text in rows:
        n_term.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", text)})
        for c in pii.contexts(text, chosen):
            n_entity[c["entity"]] += 1
            n_both.update((c["entity"], t) for t in c["terms"])
    found = {}
    for (entity, term), both in n_both.items():
        share = math.log(n * both / (n_term[term] * n_entity[entity]))
        share /= max(math.log(n / n_entity[entity]), 1e-9)
        if both >= chosen.least_contexts and share >= chosen.generalise_at:
            found[term] = max(found.get(term, 0.0), share)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_equal_the_plain_version(spark, documents, seed):
    rng, chosen = random.Random(seed), pii.Settings()
    names = ["ann", "bertha", "carl", "dora", "emil", "frieda"]
    rows = []
    for i in range(90):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuvwx')}{rng.choice('abcdefgh')}" for _ in range(40)]
        for _ in range(rng.randrange(3)):
            who = rng.randrange(6)
            at = rng.randrange(len(words))
            near = names[who] if rng.random() < 0.8 else rng.choice(names)
            words[at:at] = [near, f"p{who}@host.example"] if rng.random() < 0.9 else [f"p{who}@host.example"]
        if rng.random() < 0.1:
            words.append(rng.choice(names))
        rows.append((i, " ".join(words)))
    want = plain_shares(rows, chosen)
    out = pii.sanitise(documents(rows), Scratch(spark, "t")).collect()
    found = {r.text[s.start : s.end].lower() for r in out for s in r.spans if s.kind == "term"}
    assert want and found == set(want)
    removed = {t for t, share in want.items() if share >= chosen.remove_at}
    for r in out:
        assert not removed & set(r.sanitised.lower().split())
