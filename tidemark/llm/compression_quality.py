"""Compression classifier: zstandard dictionaries of good and of bad texts, compared block by block.

A text is compressed in blocks of ``BLOCK`` bytes with either dictionary, so that the dictionaries keep their
say to the end of a long text. The difference of the compressed sizes over the text's bytes is the one feature; it becomes
a probability by a logistic calibration on it and its signed square, fitted on labelled rows that built neither dictionary.

Fitted on at most 2 * ``per_label`` rows of each label, of each at most ``sample_chars`` characters from a
seeded start. Null and empty texts get the share of label 1. Repeated rows get equal scores; a label given
twice counts twice. Without labels of both kinds every text gets the share of label 1, or 0.5 without labels.
Labels are the only input besides the text; doc_id only says which rows may be learned from. An empty table gives no rows.
``score`` ignores other columns of the input; ``keep`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, crc_mod, filter_by_text, first_rows, lean

BLOCK = 1024
FOLDS = 5
THRESHOLD = 0.3
LEVEL, DICT_BYTES = 5, 1 << 19
RIDGE, ENOUGH = 1e-2, 300


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    prior: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)] if model.good else []
        self.empty = [len(c.compress(b"")) for c in self.pair]

    def features(self, text: str) -> np.ndarray:
        """A constant, ten times the normalised difference, and its signed square."""
        data = text.encode()
        good, bad = (sum(len(c.compress(data[i : i + BLOCK])) - e for i in range(0, len(data), BLOCK)) for c, e in zip(self.pair, self.empty, strict=True))
        diff = 10 * (bad - good) / len(data)
        return np.array([1.0, diff, diff * abs(diff)])

    def __call__(self, text: str | None) -> float:
        if not text or not self.pair:
            return self.model.prior
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.model.weights, -30, 30))))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b" " * 8  # too few samples to train on: their raw content


def fit_logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the first column is the constant."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 0

    def loss(w: np.ndarray) -> float:
        return float(sample_weight @ (np.logaddexp(0, z @ w) - y * (z @ w)) + penalty @ (w * w) / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (sample_weight * (p - y)) + penalty * w
        step = np.linalg.solve((z * (sample_weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-8), grad)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    w /= scale
    w[0] -= w[1:] @ mean[1:]
    return w


def train(rows: list[tuple[str, int]], counts: dict[int, int], dict_bytes: int = DICT_BYTES) -> Model:
    """``rows``: texts and labels 0 or 1, in a fixed order; ``counts``: how often each label occurs in all."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    sides = [[t for t, y in rows if t and y == label] for label in (1, 0)]
    if min(map(len, sides)) < 4:
        return Model(b"", b"", np.zeros(3), prior)
    build = [s[: len(s) * 2 // 3] for s in sides]
    good, bad = (_dictionary([t.encode() for t in s], dict_bytes) for s in build)
    model = Model(good, bad, np.zeros(3), prior)
    scorer = Scorer(model)
    x, y, w = [], [], []
    for s, b, label in zip(sides, build, (1, 0), strict=True):
        rest = s[len(b) :]
        x += [scorer.features(t) for t in rest]
        y += [label] * len(rest)
        w += [counts[label] / total / len(rest)] * len(rest)
    # A handful of rows can't settle the weights: below ENOUGH rows of the rarer label the ridge grows as they get fewer.
    few = min(sum(y), len(y) - sum(y))
    model.weights = fit_logistic(np.array(x), np.array(y, float), np.array(w) * len(y), RIDGE * max(1.0, ENOUGH / few))
    return model


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2000, sample_chars: int = 8192, seed: int = 4) -> Model:
    """Fit on labels whose crc32 of the doc_id is not 0 modulo ``FOLDS``."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", FOLDS) != 0))
    counts = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    picked = bounded_sample(usable, "doc_id", "quality", per_label, seed)
    if not picked:
        return train([], counts)
    # At most 4 * per_label rows, so the broadcast is bounded.
    keys = spark.createDataFrame([(int(r["key"]), int(r["label"]), int(r["draw"])) for r in picked], "doc_id long, label int, draw long")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.length("text") - sample_chars, F.lit(0)).cast("long") + 1)
    texts = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").select("draw", "label", "doc_id", F.substring("text", start, F.lit(sample_chars)).alias("text"))
    # Rows that repeat a doc_id with other texts may exceed the bound; the first by draw and content count.
    rows = first_rows(texts.where(F.col("text") != ""), 8 * per_label, "draw", "doc_id", "label")
    return train([(r["text"], r["label"]) for r in rows], counts)


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(scores, pa.float64())], names=[*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, for every row."""
    return docs.select("doc_id", "text").mapInArrow(lean(_score(model)), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns."""

    def judge() -> Callable[[str | None], bool]:
        scorer = Scorer(model)
        return lambda text: scorer(text) >= threshold

    return filter_by_text(docs, judge)
