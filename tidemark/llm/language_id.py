"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of two to four bytes of the lower-cased text that hold no space inside, a space at either end
marking the end of a word; anything but letters and their marks counts as a space. Embeddings and softmax are trained together by stochastic gradient descent. A
temperature, fitted on rows kept from training, turns the softmax into probabilities, and the threshold below
which a prediction is rejected is a low quantile of those of right predictions.

Fitted on at most 2 * ``per_label`` rows of each language, of each at most ``sample_chars`` characters from a
seeded start. A text that is null or has no letter is ``und`` with score 0 and is not accepted; so is every
text if there is nothing to learn from. Repeated rows get equal results. lang, source and doc_id are never
inputs of a prediction. Of more languages than ``bounded_sample`` takes, the most frequent are learned. An empty table gives
no rows. ``identify`` ignores other columns of the input; ``keep`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, crc_mod, filter_by_text, lean

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
BUCKET_BITS = 15
DIM = 16
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = np.zeros(256, np.uint8)
_SPACED[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SPACED[128:] = np.arange(128, 256)


class _Blank(dict):
    """For ``str.translate``: letters and marks as they are, all else a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if unicodedata.category(chr(code))[0] in "LM" else 32
        return self[code]


_BLANK = _Blank()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # per subword bucket and language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(text: str) -> np.ndarray:
    """How often each bucket occurs; the mean over all is taken later."""
    counts = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    text = text.lower()
    data = np.frombuffer(f" {text if text.isascii() else text.translate(_BLANK)} ".encode(), np.uint8)
    for at in range(0, len(data), 1 << 20):  # long texts in pieces that overlap by three bytes
        codes = _SPACED[data[at : at + (1 << 20) + 3]]
        c = codes.astype(np.uint32)
        gram, inner = c, np.zeros(max(0, len(c) - 1), bool)
        for n in (2, 3, 4):
            gram = gram[:-1] * np.uint32(257) + c[n - 1 :]
            if n > 2:
                inner = inner[:-1] | (codes[n - 2 : -1] == 0)
            h = (((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
            h[inner if n > 2 else (codes[:-1] | codes[1:]) == 0] = 1 << BUCKET_BITS
            last = at + (1 << 20) < len(data)
            counts += np.bincount(h[: 1 << 20] if last else h, minlength=len(counts))
    return counts[:-1]


def _sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            hidden = share @ embed[at]
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= step * np.outer(hidden, p)
            bias -= step * 0.1 * p
            embed[at] -= (step * 20) * share[:, None] * back
    return embed, weights, bias


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(samples: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 3, quantile: float = 0.001) -> Model | None:
    """``samples``: texts and languages, in a fixed order; one in five calibrates."""
    samples = [(t, y) for t, y in samples if t and _LETTER.search(t)]
    languages = sorted({y for _, y in samples})
    if not languages:
        return None
    rows, labels = [], np.array([languages.index(y) for _, y in samples])
    for text, _ in samples:
        counts = subwords(text)
        at = np.flatnonzero(counts)
        rows.append((at, counts[at] / max(1, counts.sum())))
    held = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~held)
    embed, weights, bias = _sgd([rows[i] for i in fit], labels[fit], len(languages), epochs, rate, seed)
    model = Model(languages, embed @ weights, bias, 1.0, 0.0)
    check = np.flatnonzero(held)
    if len(check):
        logits = np.array([share @ model.table[at] for at, share in (rows[i] for i in check)]) + bias
        right = labels[check]
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
        nll = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(check)), right], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        p = _softmax(logits / model.temperature)
        good = p.max(1)[p.argmax(1) == right]
        model.threshold = float(min(0.5, np.quantile(good, quantile))) if len(good) else 0.0
    return model


def learn(docs: DataFrame, per_label: int = 800, sample_chars: int = 2000, seed: int = 3) -> Model | None:
    """Fit on rows with a language whose crc32 of the doc_id modulo ``FOLDS`` is not ``HELD_OUT``."""
    usable = docs.select("doc_id", "lang", "text").where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.length("text") - sample_chars, F.lit(0)).cast("long") + 1)
    rows = bounded_sample(usable, "doc_id", "lang", per_label, seed, F.substring("text", start, F.lit(sample_chars)).alias("text"))
    # Short texts have to be told apart too: every other sample is cut to some forty to two hundred characters.
    return train([(r["text"] if i % 2 else r["text"][: 40 + r["draw"] % 160], r["label"]) for i, r in enumerate(rows) if r["text"]])


def predict(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """Language, probability and whether it is accepted."""
    if model is None or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    counts = subwords(text)
    p = _softmax((counts @ model.table / max(1, counts.sum()) + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] >= model.threshold)


def _predict(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted for every row."""
    return docs.select("doc_id", "text").mapInArrow(lean(_predict(model)), "doc_id long, lang_pred string, score double, accepted boolean")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns."""
    return filter_by_text(docs, lambda: lambda text: predict(model, text)[2])
