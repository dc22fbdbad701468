"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at counts of one text and says good (+1), bad (-1) or nothing (0). Nobody says
which rule is right: expectation-maximisation finds, from how the votes of all documents agree, how
often each rule is right on good and on bad documents, and the share of good ones. A document's
posterior probability of being good replaces the demand that it pass every rule.

Votes are few, so documents fall into at most 3 ** len(RULES) patterns. Spark counts the patterns
over all documents; only these counts, whose number does not grow with the input, reach the driver.

Null and empty texts have no words and zero counts; they fail the base rules. Ties (posterior of
exactly one half) are kept. Repeated rows are separate documents with equal results. On an empty
table the fit returns its starting values.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.frames import add_columns

COUNTS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_lower",
    "n_letters",
    "n_plain_words",
]
_SCHEMA = ", ".join(f"{name} bigint" for name in COUNTS)

#: A word of letters (any non-ASCII character counts as one), with at most one mark behind it.
_PLAIN = re.compile(rb"(?<![^\x20\x09-\x0D])[A-Za-z\x80-\xFF'-]++[.,;:!?]?(?![^\x20\x09-\x0D])")
_BLANKS = " \t\n\x0b\x0c\r"


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    distinct, n = len(numbers), len(words)
    if n < 4:
        return 0, distinct
    pair = ids[:-1] * distinct + ids[1:]
    if distinct**3 >= 2**63:
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(
        pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True
    )
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum()), distinct


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the ASCII blanks only
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)] if words else []
    byte = np.frombuffer(raw, np.uint8)
    classes = np.bincount(byte, minlength=256)
    blanks = int(classes[9:14].sum() + classes[32])
    repeated, distinct = _repeated(words)
    return (
        len(words),
        len(text) - blanks,
        sum(int(classes[ord(c)]) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        distinct,
        int(classes[65:91].sum()),
        int(classes[97:123].sum()),
        int(classes[65:91].sum() + classes[97:123].sum() + classes[192:].sum()),
        len(_PLAIN.findall(raw)),
    )


def _count_batch(texts: pa.Array) -> list[pa.Array]:
    rows = np.array([count_text(t) for t in texts.to_pylist()], np.int64)
    return [pa.array(column) for column in rows.reshape(-1, len(COUNTS)).T]


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` and the columns of COUNTS (existing columns of these names are replaced)."""
    return add_columns(docs, _count_batch, [text], _SCHEMA, () if keep_text else (text,))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    if good is not None:
        vote = vote.when(good, 1)
    return F.coalesce(vote, F.lit(0))


#: The rules, in the order of ``_rules``.
RULES = (
    "length",
    "symbols",
    "repetition",
    "lines",
    "word_length",
    "shouting",
    "variety",
    "letters",
    "symbol_share",
    "plain_words",
)
_VOTES = [f"_vote_{name}" for name in RULES]


def _rules() -> dict[str, Column]:
    words, chars, letters = F.col("n_words"), F.col("word_chars"), F.col("n_letters")
    cased = F.col("n_upper") + F.col("n_lower")
    mean = F.try_divide("word_chars", "n_words")
    return {
        "length": _vote(words < 50, words >= 80),
        "symbols": _vote(F.col("n_symbols") * 10 > words, F.col("n_symbols") * 100 < words),
        "repetition": _vote(F.col("n_repeat_words") * 5 > words),
        "lines": _vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "word_length": _vote((mean < 2.5) | (mean > 15), (mean >= 3.5) & (mean <= 9)),
        "shouting": _vote(F.col("n_upper") * 2 > cased, F.col("n_upper") * 5 < cased),
        "variety": _vote(
            (words >= 50) & (F.col("n_distinct_words") * 5 < words) & (words < 2000),
            F.col("n_distinct_words") * 3 > words,
        ),
        "letters": _vote(letters * 4 < chars * 3, letters * 10 > chars * 9),
        "symbol_share": _vote(F.col("n_symbols") * 20 > chars),
        "plain_words": _vote(F.col("n_plain_words") * 3 < words * 2, F.col("n_plain_words") * 10 > words * 9),
    }


@dataclass(frozen=True)
class LabelModel:
    """What EM estimates: the share of good documents, and for each rule how often it votes good,
    bad or not at all on documents of either class."""

    prior: float
    if_good: tuple[tuple[float, float, float], ...]
    if_bad: tuple[tuple[float, float, float], ...]

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right where it votes."""
        out = {}
        for name, (g, b, _), (g_bad, b_bad, _) in zip(RULES, self.if_good, self.if_bad):
            right = self.prior * g + (1 - self.prior) * b_bad
            out[name] = right / (right + self.prior * b + (1 - self.prior) * g_bad)
        return out

    def log_odds(self) -> Column:
        """Of good against bad."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, good, bad in zip(_VOTES, self.if_good, self.if_bad):
            says_good, says_bad, nothing = (math.log(g / b) for g, b in zip(good, bad))
            odds = odds + (
                F.when(F.col(vote) > 0, says_good)
                .when(F.col(vote) < 0, says_bad)
                .otherwise(nothing)
            )
        return odds


#: Where EM starts, and what it is pulled to with the weight of PRIOR_DOCUMENTS documents:
#: shares of (good, bad, abstain) votes on good and on bad documents.
START_IF_GOOD = (0.70, 0.02, 0.28)
START_IF_BAD = (0.50, 0.30, 0.20)
START_PRIOR = 0.85
PRIOR_DOCUMENTS = 10


def expectation_maximisation(
    votes: np.ndarray, weights: np.ndarray, rounds: int = 500, tolerance: float = 1e-10
) -> LabelModel:
    """Fit to patterns of votes (rows) that stand for ``weights`` documents each.

    Rules are taken to be no worse than chance: after each round, none may vote bad more often on
    good than on bad documents, or good more often on bad ones. This fixes which class is good.
    """
    rules = votes.shape[1]
    cast = np.stack([votes > 0, votes < 0, votes == 0], axis=2).astype(float)
    good, bad = np.tile(START_IF_GOOD, (rules, 1)), np.tile(START_IF_BAD, (rules, 1))
    pull_good, pull_bad = good * PRIOR_DOCUMENTS, bad * PRIOR_DOCUMENTS
    prior, total, last = START_PRIOR, float(weights.sum()), -math.inf
    for _ in range(rounds if total else 0):
        if_good = (cast * np.log(good)).sum(axis=(1, 2)) + math.log(prior)
        if_bad = (cast * np.log(bad)).sum(axis=(1, 2)) + math.log1p(-prior)
        both = np.logaddexp(if_good, if_bad)
        is_good = weights * np.exp(if_good - both)
        is_bad = weights - is_good
        prior = float(np.clip((is_good.sum() + 1) / (total + 2), 0.02, 0.98))
        good = np.tensordot(is_good, cast, 1) + pull_good
        bad = np.tensordot(is_bad, cast, 1) + pull_bad
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        good[:, 1] = np.minimum(good[:, 1], bad[:, 1])
        bad[:, 0] = np.minimum(bad[:, 0], good[:, 0])
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        now = float(weights @ both) / total
        if abs(now - last) < tolerance:
            break
        last = now
    rows = lambda x: tuple(tuple(map(float, r)) for r in x)
    return LabelModel(prior, rows(good), rows(bad))


def _with_votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"_vote_{k}": v.cast("int") for k, v in _rules().items()})


def fit(counted: DataFrame) -> LabelModel:
    """EM over the vote patterns of all rows of ``with_counts``."""
    patterns = _with_votes(counted.select(*COUNTS)).groupBy(*_VOTES).count().orderBy(*_VOTES)
    rows = np.array([tuple(r) for r in patterns.collect()], np.int64)
    rows = rows.reshape(-1, len(_VOTES) + 1)
    return expectation_maximisation(rows[:, :-1], rows[:, -1].astype(float))


def judge(counted: DataFrame, model: LabelModel, least: float = 0.5) -> DataFrame:
    """Add base_failed, quality (posterior probability) and kept to rows of ``with_counts``."""
    posterior = 1 / (1 + F.exp(-model.log_odds()))
    return (
        _with_votes(counted)
        .withColumns({"base_failed": base_failed(), "quality": posterior})
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
        .drop(*_VOTES)
    )
