"""Language identification with a bidirectional gated recurrent network over bytes.

Two GRUs read the UTF-8 bytes of a text, one from either side; from both states every position gets
a probability for each language, and a document's probabilities are the means over its positions.
The network is trained here, in numpy, by backpropagation through time with Adam.

*Windows.* The whole text is labelled, in windows of ``window`` bytes; the states start anew in each
window, so a text of any length is many short sequences, which are run side by side. The last
window is moved back to be full, and positions seen before count once.

*Training sample.* The network learns from at most about ``documents_per_language`` documents of
each language, picked by a hash of the id, and ``windows_per_document`` windows of each; only these
windows (``window`` bytes each) reach the driver. This bound is independent of the table's size.

Only the text is an input. A text that is null or has no letter is ``und`` with score 0; so is every
text where there was nothing to learn from. Ties go to the language that sorts first. Repeated rows
get equal results. Existing columns called ``lang_pred`` or ``score`` are replaced. Languages are
the distinct non-null labels; one label alone gives that label with score 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.frames import add_columns, text_of

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    hidden: int = 6
    window: int = 96
    documents_per_language: int = 600
    windows_per_document: int = 3
    steps: int = 240
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Weights: by direction, gates (reset, update, candidate) of every byte and of the state."""

    languages: tuple[str, ...]
    byte_gates: np.ndarray  # 2, 3 * hidden, 256
    state_gates: np.ndarray  # 2, 3 * hidden, hidden
    output: np.ndarray  # languages, 2 * hidden
    bias: np.ndarray  # languages
    window: int


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    np.exp(logits - logits.max(axis=axis, keepdims=True), out=logits)
    logits /= logits.sum(axis=axis, keepdims=True)
    return logits


def _loss_and_gradients(weights: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """``x``: bytes (positions, sequences); ``y``: a language for each sequence."""
    steps, size = x.shape
    hidden = weights["state"].shape[2]
    index = np.stack([x, x[::-1]])
    gates = np.stack([weights["byte"][d][:, index[d]] for d in (0, 1)])
    h = np.zeros((2, hidden, size), np.float32)
    before, kept, states = [], [], np.empty((2, steps, hidden, size), np.float32)
    for t in range(steps):
        g, s = gates[:, :, t], weights["state"] @ h
        rz = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * hidden] + s[:, : 2 * hidden]))
        r, z, m = rz[:, :hidden], rz[:, hidden:], s[:, 2 * hidden :]
        n = np.tanh(g[:, 2 * hidden :] + r * m)
        before.append(h)
        kept.append((r, z, m, n))
        h = h + z * (n - h)
        states[:, t] = h
    both = np.concatenate([states[0], states[1][::-1]], axis=1)
    p = _softmax(weights["output"] @ both + weights["bias"][:, None], 1)
    picked = p[:, y, np.arange(size)]
    loss = float(-np.log(picked + 1e-9).mean())
    p[:, y, np.arange(size)] -= 1
    p /= steps * size
    grads = {
        "output": np.einsum("tkb,thb->kh", p, both, optimize=True),
        "bias": p.sum(axis=(0, 2)),
        "state": np.zeros_like(weights["state"]),
    }
    d_both = weights["output"].T @ p
    d_states = np.stack([d_both[:, :hidden], d_both[::-1, hidden:]])
    d_gates = np.empty_like(gates)
    d_h = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        (r, z, m, n), previous = kept[t], before[t]
        d_h = d_h + d_states[:, t]
        d_n = d_h * z * (1 - n * n)
        d_z = d_h * (n - previous) * z * (1 - z)
        d_r = d_n * m * r * (1 - r)
        d_s = np.concatenate([d_r, d_z, d_n * r], axis=1)
        d_gates[:, : 2 * hidden, t] = d_s[:, : 2 * hidden]
        d_gates[:, 2 * hidden :, t] = d_n
        grads["state"] += d_s @ previous.transpose(0, 2, 1)
        d_h = d_h * (1 - z) + weights["state"].transpose(0, 2, 1) @ d_s
    grads["byte"] = np.stack(
        [
            [np.bincount(index[d].ravel(), row.ravel(), 256) for row in d_gates[d]]
            for d in (0, 1)
        ]
    ).astype(np.float32)
    return loss, grads


def train(windows: list[tuple[str, bytes]], settings: Settings) -> Model:
    """Fit to (language, bytes) pairs; every language is drawn equally often."""
    rng = np.random.default_rng(settings.seed)
    languages = sorted({language for language, _ in windows})
    hidden, k = settings.hidden, len(languages)
    x = np.full((len(windows), settings.window), 32, np.uint8)
    for row, (_, data) in zip(x, windows):
        row[: len(data)] = np.frombuffer(data, np.uint8)[: settings.window]
    y = np.array([languages.index(language) for language, _ in windows], np.int64)
    of_language = [np.flatnonzero(y == i) for i in range(k)]
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    weights = {
        "byte": normal(2, 3 * hidden, 256, scale=0.3),
        "state": normal(2, 3 * hidden, hidden, scale=1 / np.sqrt(hidden)),
        "output": normal(k, 2 * hidden, scale=0.3),
        "bias": np.zeros(k, np.float32),
    }
    weights["byte"][:, hidden : 2 * hidden] -= 1  # states change slowly at first
    first = {name: np.zeros_like(w) for name, w in weights.items()}
    second = {name: np.zeros_like(w) for name, w in weights.items()}
    for step in range(settings.steps if k > 1 else 0):
        label = rng.integers(0, k, settings.batch)
        rows = np.array([of_language[i][rng.integers(len(of_language[i]))] for i in label])
        _, grads = _loss_and_gradients(weights, np.ascontiguousarray(x[rows].T), y[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = settings.rate * min(1.0, (step + 1) / 20) * (1 - step / settings.steps)
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            mean = first[name] / (1 - 0.9 ** (step + 1))
            scale = np.sqrt(second[name] / (1 - 0.99 ** (step + 1))) + 1e-8
            weights[name] -= (rate * mean / scale).astype(np.float32)
    return Model(
        tuple(languages), weights["byte"], weights["state"], weights["output"], weights["bias"],
        settings.window,
    )


def label_positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (positions, languages, sequences) for bytes (positions, sequences)."""
    steps, size = x.shape
    h3, hidden = model.state_gates.shape[1:]
    two = 2 * hidden
    # Half the gates' input, so that a sigmoid is a tanh.
    half = np.ones((h3, 1), np.float32)
    half[:two] = 0.5
    table, recur = model.byte_gates * half, model.state_gates * half
    states = np.empty((2, steps, hidden, size), np.float32)
    g, s = np.empty((2, h3, size), np.float32), np.empty((2, h3, size), np.float32)
    h = np.zeros((2, hidden, size), np.float32)
    rz, n = np.empty((2, two, size), np.float32), np.empty((2, hidden, size), np.float32)
    for t in range(steps):
        np.take(table[0], x[t], axis=1, out=g[0], mode="clip")
        np.take(table[1], x[steps - 1 - t], axis=1, out=g[1], mode="clip")
        np.matmul(recur, h, out=s)
        np.add(g[:, :two], s[:, :two], out=rz)
        np.tanh(rz, out=rz)
        rz *= 0.5
        rz += 0.5
        np.multiply(rz[:, :hidden], s[:, two:], out=n)
        n += g[:, two:]
        np.tanh(n, out=n)
        n -= h
        n *= rz[:, hidden:]
        h = np.add(h, n, out=states[:, t])
    both = np.concatenate([states[0], states[1][::-1]], axis=1)
    return _softmax(model.output @ both + model.bias[:, None], 1)


def document_probabilities(model: Model, texts: pa.Array, side_by_side: int = 1024) -> np.ndarray:
    """Mean over all positions of each text (rows); zeros for an empty one."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    content = texts.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    width, lengths = model.window, np.diff(offsets)
    counts = -(-lengths // width)
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    wanted = (np.arange(len(doc)) - first[doc]) * width
    begin = np.minimum(wanted, np.maximum(lengths[doc] - width, 0))
    total = np.zeros((len(lengths), len(model.languages)))
    place = np.arange(width)
    for i in range(0, len(doc), side_by_side):
        part = slice(i, i + side_by_side)
        at = begin[part] + place[:, None]
        inside = at < lengths[doc[part]]
        where = np.where(inside, at, 0) + offsets[doc[part]]
        x = np.where(inside, data[where], 32).astype(np.uint8)
        p = label_positions(model, x)
        new = inside & (at >= wanted[part])
        sums = np.einsum("tkb,tb->bk", p, new.astype(np.float32))
        np.add.at(total, doc[part], sums)
    return total / np.maximum(lengths, 1)[:, None]


def held_out(id: str = "doc_id") -> Column:
    """Documents that nothing is learnt from; one without an id is held out, too."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _sample(docs: DataFrame, settings: Settings, id: str, text: str, lang: str) -> tuple[DataFrame, int]:
    """Labelled documents with letters, about ``documents_per_language`` of each language by a hash of
    the id, as _id, _text and _lang; and the number of languages."""
    given = docs.select(
        F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")
    ).where(F.col("_lang").isNotNull())
    counts = {r["_lang"]: r["count"] for r in given.groupBy("_lang").count().collect()}
    scale = 1 << 30
    share = F.create_map(
        *[
            F.lit(v)
            for language, n in (counts or {"": 1}).items()
            for v in (language, min(scale, scale * settings.documents_per_language // n + 1))
        ]
    )
    pick = F.pmod(F.xxhash64("_id", F.lit(settings.seed)), F.lit(scale))
    return given.where((pick < share[F.col("_lang")]) & F.col("_text").rlike(r"\p{L}")), len(counts)


def sample_windows(
    docs: DataFrame, settings: Settings, id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> list[tuple[str, bytes]]:
    """The bounded training sample of ``docs``, in a fixed order."""
    picked, languages = _sample(docs, settings, id, text, lang)
    data, width = F.col("_text").cast("binary"), settings.window
    room = F.greatest(F.octet_length(data) - (width - 1), F.lit(1))
    windows = [
        F.substr(data, (F.pmod(F.xxhash64("_id", F.lit(j)), room) + 1).cast("int"), F.lit(width))
        for j in range(settings.windows_per_document)
    ]
    rows = picked.select("_lang", F.explode(F.array(*windows)).alias("window"))
    # Repeated ids are picked together, hence a bound of its own.
    most = 2 * languages * settings.documents_per_language * settings.windows_per_document
    return sorted((r["_lang"], bytes(r["window"])) for r in rows.limit(most).collect())


def least_right(found: DataFrame, text: str = "text", lang: str = "lang") -> float:
    """The least score of a row of ``identify`` that is given its own label; 0 where there is none.

    All rows count, whatever their number: labelled texts with letters.
    """
    right = (F.col("lang_pred") == F.col(lang)) & F.col(text).rlike(r"\p{L}")
    return found.where(right).agg(F.min("score")).first()[0] or 0.0


def least_score(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> float:
    """The least score with which any labelled document of ``docs`` is given its own language."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    return least_right(identify(labelled, model, "_text"), "_text", "_lang")


def fit(docs: DataFrame, settings: Settings = Settings(), **columns: str) -> Model | None:
    """A model learnt from the rows of ``docs``, or None where no row has a label and letters."""
    windows = sample_windows(docs, settings, **columns)
    return train(windows, settings) if windows else None


def identify(
    docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True
) -> DataFrame:
    """Add lang_pred and score."""
    marked = docs.drop("_letters").withColumn("_letters", text_of(text).rlike(r"\p{L}"))

    def label(texts: pa.Array, letters: pa.Array) -> list[pa.Array]:
        known = np.array(letters.to_pylist(), bool)
        if model is None:
            known[:] = False
            best = score = np.zeros(len(known))
        else:
            p = document_probabilities(model, texts.fill_null(""))
            best, score = p.argmax(axis=1), p.max(axis=1)
        names = [model.languages[int(b)] if k else UNKNOWN for b, k in zip(best, known)]
        score = np.clip(np.where(known, score, 0.0), 0.0, 1.0)
        return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

    without = ("_letters",) if keep_text else ("_letters", text)
    return add_columns(marked, label, [text, "_letters"], "lang_pred string, score double", without)
