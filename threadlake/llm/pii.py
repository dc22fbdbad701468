"""Personal data: fixed kinds by pattern, revealing terms by information theory.

*Base kinds* are found in every text by pattern and check digit: email, ip, card, phone.

*Terms* are words that give a protected entity (one address, one number) away although they are no
personal data themselves, such as a name that stands beside the same number again and again. Over
the whole corpus, with p counted in documents (one with an entity in two surroundings counts twice),

    PMI(term; entity) = log p(term near entity) / (p(term) p(entity)),   IC(entity) = -log p(entity)

and PMI / IC is the share of the entity's information that the term discloses (1: the term occurs
with no other document). A term counts only when it stands near the entity in at least
``least_contexts`` independent places. Near-duplicate texts (see ``near_duplicates``; the classes are
made of the texts that hold entities in question) count as one, so that copies prove nothing, while
a fixed phrase in unrelated texts does; a text counts as often as it has the term near the entity in
different surroundings (the three words on either side), and a class as its richest text. Terms that
disclose ``generalise_at`` or more become a more general term (``<NAME>`` for a capitalised word,
``<MEASURE>`` for one beside a number, else ``<WORD>``); at ``remove_at`` or more they are removed.
Base spans become ``<EMAIL>`` and so on; where spans overlap, the first one's label stands for all.

A null or empty text has no spans and stays as it is. Repeated rows are separate documents (they
count in p, never as other surroundings). An empty table gives an empty result. Existing columns
called ``spans`` or ``sanitised`` are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.frames import add_columns, text_of
from threadlake.llm.near_duplicates import near_duplicates
from threadlake.operators.skew import lookup
from threadlake.scratch import Scratch

#: In the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Whole runs of numbers with single dots between; addresses are cut from them four numbers at a time.
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = "0123456789"
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each '@' outwards so that long runs stay linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            out.append(("email", start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _addresses(text: str) -> list[Span]:
    out = []
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 7:
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    out.append(("ip", start, end))
                start = end + 1
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str | None) -> list[Span]:
    """Spans (kind, start, end) in code points, by start, then by kind."""
    if not text:
        return []
    out = _emails(text) if "@" in text else []
    if not any(d in text for d in _DIGITS):
        return out
    if "." in text:
        out += _addresses(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return in_order(out)


class _Taken:
    """Whether a range meets one of the spans, by binary search over their merged ranges."""

    def __init__(self, spans: list[Span]) -> None:
        self._starts: list[int] = []
        self._ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self._ends and start <= self._ends[-1]:
                self._ends[-1] = max(self._ends[-1], end)
            else:
                self._starts.append(start)
                self._ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self._ends, start)
        return i < len(self._starts) and self._starts[i] < end


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@dataclass(frozen=True)
class Settings:
    reach_words: int = 10
    reach_chars: int = 200
    surrounding_words: int = 3
    least_contexts: int = 3
    generalise_at: float = 0.7
    remove_at: float = 0.95


def _entity(kind: str, value: str) -> str:
    """A key that does not carry the value itself."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else _NO_DIGIT.sub("", value)
    return hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=16).hexdigest()


def contexts(text: str | None, settings: Settings) -> list[dict]:
    """For each entity of a text: the terms around its occurrences, and hashes of surroundings."""
    spans = base_spans(text)
    found: dict[tuple[str, int], set[str]] = {}
    taken = _Taken(spans)
    for kind, start, end in spans:
        before = max(start - settings.reach_chars, 0)
        left = list(_TERM.finditer(text, before, start))[-settings.reach_words :]
        right = _TERM.finditer(text, end, end + settings.reach_chars)
        right = list(islice(right, settings.reach_words))
        terms = {m[0].lower() for m in (*left, *right) if not taken.meets(*m.span())}
        closest = left[-settings.surrounding_words :], right[: settings.surrounding_words]
        closest = "\n".join(m[0].lower() for m in (*closest[0], *closest[1]))
        around = hashlib.blake2b(closest.encode(), digest_size=8).digest()
        key = _entity(kind, text[start:end]), int.from_bytes(around, "big", signed=True)
        found.setdefault(key, set()).update(terms)
    return [{"entity": e, "around": a, "terms": sorted(t)} for (e, a), t in found.items()]


_CONTEXTS = pa.list_(
    pa.struct([("entity", pa.string()), ("around", pa.int64()), ("terms", pa.list_(pa.string()))])
)


def _row_key(text: str) -> Column:
    return F.md5(text_of(text).cast("binary"))


def _near(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Terms near entities per text (key), with its number of documents: entity, around, terms, n.

    Rows without an entity hold all terms that a text has near any entity, each once.
    """

    def with_union(found: list[dict]) -> list[dict]:
        terms = sorted({t for c in found for t in c["terms"]})
        return [*found, {"entity": None, "around": None, "terms": terms}] if terms else found

    def collect(texts: pa.Array) -> list[pa.Array]:
        found = [with_union(contexts(t, settings)) for t in texts.to_pylist()]
        return [pa.array(found, _CONTEXTS)]

    found = add_columns(
        docs.select(text, F.unhex(_row_key(text)).alias("key")),
        collect,
        [text],
        "found array<struct<entity:string,around:bigint,terms:array<string>>>",
        (text,),
    )
    return (
        found.select("key", F.inline("found"))
        .groupBy("key", "entity", "around", "terms")
        .agg(F.count("*").alias("n"))
    )


def _terms(docs: DataFrame, text: str) -> DataFrame:
    """Distinct terms of each document, one row each, under the key of its text."""

    def collect(texts: pa.Array) -> list[pa.Array]:
        return [
            pa.array(
                [sorted({w.lower() for w in _TERM.findall(t or "")}) for t in texts.to_pylist()],
                pa.list_(pa.string()),
            )
        ]

    keyed = docs.select(text, _row_key(text).alias("key"))
    listed = add_columns(keyed, collect, [text], "terms array<string>", (text,))
    return listed.select("key", F.explode("terms").alias("term"))


def _evidence(
    docs: DataFrame, text: str, near: DataFrame, together: DataFrame, scratch: Scratch, apart: bool
) -> DataFrame:
    """In how many independent places the terms stand near the entities of ``together``.

    entity, term, contexts; further terms of these entities are listed, too. ``apart``: the texts are
    known to hold no near-duplicates, so each is a class of its own.
    """
    near = near.join(together.select("entity").distinct(), "entity", "left_semi")
    keyed = docs.select(F.unhex(_row_key(text)).alias("key"), F.col(text).alias("text"))
    texts = keyed.join(near.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    if apart:
        classes = near.select("key", F.col("key").alias("class_id")).distinct()
    else:
        texts = scratch.write(texts, "texts")
        inner = Scratch(docs.sparkSession, "pii-classes")
        classes = scratch.write(near_duplicates(texts, inner, "key", "text"), "classes")
        inner.drop_all()
        scratch.drop(texts)
    in_text = near.join(classes, "key").select(
        "entity", "class_id", "key", F.explode("terms").alias("term")
    )
    in_text = in_text.groupBy("entity", "term", "class_id", "key").agg(F.count("*").alias("n"))
    in_class = in_text.groupBy("entity", "term", "class_id").agg(F.max("n").alias("n"))
    return in_class.groupBy("entity", "term").agg(F.sum("n").alias("contexts"))


def revealing_terms(
    docs: DataFrame, text: str, settings: Settings, scratch: Scratch, apart: bool = False
) -> DataFrame | None:
    """Per text (key) the terms that give an entity away: key, flagged array of (term, share).

    None where the corpus has no such term.
    """
    written = scratch.write(_near(docs, text, settings), "near")
    near = written.where(F.col("entity").isNotNull())
    entities = near.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    listed = near.select("entity", "n", F.explode("terms").alias("term"))
    # A term is in no fewer documents than have it near an entity of any kind (each counts once),
    # which bounds its share from above and leaves out common words before any text is read again.
    unions = written.where(F.col("entity").isNull()).select("n", F.explode("terms").alias("term"))
    anywhere = unions.groupBy("term").agg(F.sum("n").alias("n_near"))
    together = (
        listed.groupBy("entity", "term")
        .agg(F.sum("n").alias("n_both"), F.count("*").alias("places"))
        .where(F.col("places") >= settings.least_contexts)
        .drop("places")
        .join(entities, "entity")
    )
    documents = F.lit(docs.count())

    def share(n_term: str) -> Column:
        information = F.ln(documents * F.col("n_both") / (F.col(n_term) * F.col("n_entity")))
        return information / F.greatest(F.ln(documents / F.col("n_entity")), F.lit(1e-9))

    together = scratch.write(
        together.join(anywhere, "term")
        .where(share("n_near") >= settings.generalise_at)
        .drop("n_near"),
        "together",
    )
    if together.isEmpty():
        return None
    proven = _evidence(docs, text, near, together, scratch, apart)
    proven = proven.where(F.col("contexts") >= settings.least_contexts).select("entity", "term")
    together = scratch.write(together.join(proven, ["entity", "term"]), "proven")
    scratch.drop(written)
    if together.isEmpty():
        return None
    matches = scratch.write(
        _terms(docs, text).join(together.select("term").distinct(), "term"), "matches"
    )
    flagged = (
        together.join(matches.groupBy("term").agg(F.count("*").alias("n_term")), "term")
        .groupBy("term")
        .agg(F.max(share("n_term")).alias("share"))
        .where(F.col("share") >= settings.generalise_at)
    )
    flagged = scratch.write(flagged, "flagged")
    if flagged.isEmpty():
        return None
    return (
        matches.distinct()
        .join(flagged, "term")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("_flagged"))
    )


def _term_spans(text: str, flagged: dict[str, float], base: list[Span]) -> list[Span]:
    free = _Taken(base)
    return [
        ("term", *m.span())
        for m in _TERM.finditer(text)
        if m[0].lower() in flagged and not free.meets(*m.span())
    ]


_BESIDE_NUMBER = re.compile(r"[0-9][ \t]?\Z"), re.compile(r"[ \t]?[0-9]")


def _more_general(text: str, start: int, end: int) -> str:
    """What kind of word a term is, as far as it and its neighbours show."""
    if text[start].isupper():
        return "<NAME>"
    if _BESIDE_NUMBER[0].search(text, max(start - 2, 0), start) or _BESIDE_NUMBER[1].match(text, end):
        return "<MEASURE>"
    return "<WORD>"


def sanitise_text(text: str, spans: list[Span], removed: set[str]) -> str:
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out.append(text[done:start])
            if kind != "term":
                out.append(f"<{kind.upper()}>")
            elif text[start:end].lower() not in removed:
                out.append(_more_general(text, start, end))
        done = max(done, end)
    return "".join(out) + text[done:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_DDL = "spans array<struct<kind:string,start:bigint,end:bigint>>, sanitised string"


def sanitise(
    docs: DataFrame,
    scratch: Scratch,
    text: str = "text",
    settings: Settings = Settings(),
    keep_text: bool = True,
    apart: bool = False,
) -> DataFrame:
    """Add all spans (base and terms, in order) and the sanitised text (null for a null text).

    ``apart`` says that no two texts are near-duplicates, which then need not be looked for.
    """
    given = docs.drop("_flagged")
    terms = revealing_terms(given, text, settings, scratch, apart)
    none = F.lit(None).cast("array<struct<term:string,share:double>>")
    if terms is None:
        marked = given.withColumn("_flagged", none)
    else:
        keyed = given.withColumn("_text_key", _row_key(text))
        # Copies of one text may be very many.
        marked = lookup(keyed, terms.withColumnRenamed("key", "_text_key"), ["_text_key"], "left")
        marked = marked.drop("_text_key")

    def apply(texts: pa.Array, flagged: pa.Array) -> list[pa.Array]:
        all_spans, clean = [], []
        for value, terms in zip(texts.to_pylist(), flagged.to_pylist()):
            spans = base_spans(value)
            shares = {t["term"]: t["share"] for t in terms or ()}
            if shares and value:
                spans = in_order(spans + _term_spans(value, shares, spans))
            removed = {t for t, share in shares.items() if share >= settings.remove_at}
            all_spans.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            clean.append(sanitise_text(value, spans, removed) if spans else value)
        return [pa.array(all_spans, _SPANS), pa.array(clean, pa.string())]

    without = ("_flagged",) if keep_text else ("_flagged", text)
    return add_columns(marked, apply, [text, "_flagged"], SPANS_DDL, without)


def digest(sanitised: DataFrame) -> list[Column]:
    """Columns derived from ``spans``: counts per base kind, hash of base spans, all spans."""
    spans = F.col("spans")

    def joined(array: Column) -> Column:
        return F.array_join(
            F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter(spans, lambda s: s["kind"] != "term")

    def count(kind: str) -> Column:
        of_kind = F.filter(spans, lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    return [
        *map(count, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    ]
