"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are hashed lower-cased words and their first four to seven bytes, of which those that tell toxic
from other labelled texts are kept; a feature's value is log(1 + occurrences). One weight vector serves all ordered
thresholds: P(grade > k) = sigmoid(w x - theta_k). The expected severity is the sum of these probabilities.

Labels are grades from 0 (not toxic) on. Where there are only 0 and 1, the toxic texts are graded 1 to ``GRADES`` by
weak labels: the sample is halved, the words that tell toxic from other texts are found on one half, and the texts of
the other half are graded by how many different ones they hold, in equal shares. So no text is graded by words that were
chosen by its own label, nor by the values that the regression sees; but such a grade says how much toxic wording there
is, not how bad people find it. Labels with more than two values are used as they are, renumbered without gaps.

Fitted on at most 2 * ``per_label`` rows of each label, of each at most ``sample_chars`` characters from a
seeded start. Null and empty texts have severity 0 and are not toxic; so have all without labels of both
kinds, and texts without any kept feature. Repeated rows get equal results. Whole texts are scored. An empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, first_rows, lean, slices
from tidemark.llm.text import Words, shingle_keys

BITS = 20
GRADES = 3
PREFIXES = (4, 5, 6, 7)
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())


@dataclass
class Model:
    buckets: np.ndarray  # the kept features' buckets, ascending
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every word and prefix occurrence, and the number of words of each row."""
    words = Words(texts, SEPARATORS)
    length = words.ends - words.starts
    rows, buckets = [words.doc], [words.hashes() >> np.uint64(64 - BITS)]
    for n in PREFIXES:
        long = length >= n
        rows.append(words.doc[long])
        buckets.append((words.hashes(n)[long] + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64), words.counts


def _occurrences(rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, times = np.unique(rows * n + ids, return_counts=True)
    return key // n, key % n, np.log1p(times)


def fit_ordinal(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = 1e-4, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean negative log-likelihood."""
    top = int(grades.max())
    free = np.concatenate((np.zeros(n_features), [1.0], np.full(top - 1, 0.5)))  # weights, first threshold, log gaps
    m, v = np.zeros_like(free), np.zeros_like(free)
    n = len(grades)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, theta = free[:n_features], np.cumsum(np.concatenate(([free[n_features]], np.exp(free[n_features + 1 :]))))
        score = np.bincount(rows, weights=w[ids] * values, minlength=n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))  # P(grade > k)
        padded = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        p = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-9)
        slope = padded * (1 - padded)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        d_theta = np.array([(slope[grades == k + 1, k + 1] / p[grades == k + 1]).sum() - (slope[grades == k, k + 1] / p[grades == k]).sum() for k in range(top)]) / n
        grad = np.empty_like(free)
        grad[:n_features] = np.bincount(ids, weights=d_score[rows] * values, minlength=n_features) + ridge * w
        back = np.cumsum(d_theta[::-1])[::-1]
        grad[n_features] = back[0]
        grad[n_features + 1 :] = back[1:] * np.exp(free[n_features + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        free = free - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:n_features], np.cumsum(np.concatenate(([free[n_features]], np.exp(free[n_features + 1 :]))))


def distinct(samples: list[tuple[str, int]], k: int = 5, held: int = 8) -> list[tuple[str, int]]:
    """The samples without near copies: half of a text's smallest shingle hashes were seen before.

    The words of a text that is copied often would pass for signs of its label.
    """
    seen: set[int] = set()
    out = []
    for text, label in samples:
        keys = shingle_keys(Words(pa.array([text], pa.string())), k)[:held].tolist()
        if not keys or 2 * sum(x in seen for x in keys) < len(keys):
            out.append((text, label))
        seen.update(keys)
    return out


def signs(rows: np.ndarray, buckets: np.ndarray, label: np.ndarray, least_z: float, least_lift: float, most: int) -> np.ndarray:
    """The buckets, ascending, that are more frequent among rows of ``label``; each row counts once."""
    pair = np.unique(rows * (1 << BITS) + buckets)
    seen, bucket = label[pair >> BITS], pair & ((1 << BITS) - 1)
    toxic, other = np.bincount(bucket[seen], minlength=1 << BITS), np.bincount(bucket[~seen], minlength=1 << BITS)
    a, b = max(1, label[np.unique(rows)].sum()), max(1, (~label[np.unique(rows)]).sum())
    share = (toxic + other + 1) / (a + b + 2)
    z = (toxic / a - other / b) / np.sqrt(share * (1 - share) * (1 / a + 1 / b))
    lift = (toxic + 0.5) / a >= least_lift * (other + 0.5) / b
    kept = np.flatnonzero((z >= least_z) & lift & (toxic >= 3))
    return np.sort(kept[np.argsort(-z[kept], kind="stable")[:most]])


def weak_grades(rows: np.ndarray, buckets: np.ndarray, label: np.ndarray, **limits: float) -> np.ndarray:
    """Grades of 0/1 labels: 0, or 1 to ``GRADES`` by the number of different signs found on the other half of the rows."""
    half = np.arange(len(label)) % 2 == 1
    amount = np.zeros(len(label))
    for side in (half, ~half):
        there = ~side[rows]
        found = signs(rows[there], buckets[there], label, **limits)
        mine = side[rows] & np.isin(buckets, found)
        amount += np.bincount(np.unique(rows[mine] * (1 << BITS) + buckets[mine]) >> BITS, minlength=len(label))
    return np.where(label, 1 + np.searchsorted(np.quantile(amount[label], np.arange(1, GRADES) / GRADES), amount), 0)


def _fit(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, use: np.ndarray, limits: dict) -> Model | None:
    """A model of the texts that are in ``use``."""
    rows, buckets = rows[use[rows]], buckets[use[rows]]
    kept = signs(rows, buckets, grades > 0, **limits)
    grades = np.unique(grades[use], return_inverse=True)[1]
    if not len(kept) or not grades.any():
        return None
    number = np.full(1 << BITS, -1)
    number[kept] = np.arange(len(kept))
    hit = number[buckets] >= 0
    place = np.cumsum(use) - 1
    return Model(kept, *fit_ordinal(*_occurrences(place[rows[hit]], number[buckets[hit]], len(kept)), grades, len(kept)))


def _above(model: Model, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """P(grade > k) of each of ``n`` texts."""
    number = np.full(1 << BITS, -1, np.int32)
    number[model.buckets] = np.arange(len(model.buckets))
    ids = number[buckets]
    rows, ids, values = _occurrences(rows[ids >= 0], ids[ids >= 0].astype(np.int64), len(model.buckets))
    score = np.bincount(rows, weights=model.weights[ids] * values, minlength=n)
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds, -30, 30)))
    above[np.bincount(rows, minlength=n) == 0] = 0  # no feature, no sign of toxicity
    return above


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """Where the shares of toxic texts at or above and of others below are best together, the middle of such
    cuts, within 0.2 and 0.8."""
    values = np.unique(np.concatenate(([0.0, 1.0], p)))
    cuts = (values[1:] + values[:-1]) / 2
    good = np.searchsorted(np.sort(p[~toxic]), cuts) / max(1, (~toxic).sum()) - np.searchsorted(np.sort(p[toxic]), cuts) / max(1, toxic.sum())
    best = cuts[good >= good.max() - 1e-12]
    return float(np.clip((best[0] + best[-1]) / 2, 0.2, 0.8))


def train(samples: list[tuple[str, int]], most: int = 4096, least_z: float = 3.0, least_lift: float = 4.0) -> Model | None:
    """``samples``: texts with grades from 0, in a fixed order."""
    samples = distinct(samples)
    grades = np.array([y for _, y in samples], int)
    label = grades > 0
    if not len(label) or label.all() or not label.any():
        return None
    limits = {"least_z": least_z, "least_lift": least_lift, "most": most}
    rows, buckets, n_words = features(pa.array([t for t, _ in samples], pa.string()))
    if grades.max() == 1:  # words come first among the features
        grades = weak_grades(rows[: n_words.sum()], buckets[: n_words.sum()], label, **limits)
    half = np.arange(len(label)) % 2 == 1
    model, sides = _fit(rows, buckets, grades, np.ones(len(label), bool), limits), [_fit(rows, buckets, grades, x, limits) for x in (half, ~half)]
    if model and all(sides):
        first, second = (_above(m, rows, buckets, len(label))[:, 0] for m in sides)
        model.cut = best_cut(np.where(half, second, first), label)
    return model


def learn(docs: DataFrame, labels: DataFrame, grade: str = "toxic", per_label: int = 2000, sample_chars: int = 16384, seed: int = 1) -> Model | None:
    """Fit on ``labels`` (doc_id and the column ``grade``: integers from 0)."""
    usable = labels.select("doc_id", F.col(grade).cast("int").alias("grade")).where(F.col("grade") >= 0)
    picked = bounded_sample(usable, "doc_id", "grade", per_label, seed)
    if not picked:
        return None
    # At most 2 * per_label rows a label, so the broadcast is bounded.
    keys = docs.sparkSession.createDataFrame([(int(r["key"]), int(r["label"]), int(r["draw"])) for r in picked], "doc_id long, label int, draw long")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.length("text") - sample_chars, F.lit(0)).cast("long") + 1)
    texts = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").select("draw", "label", "doc_id", F.substring("text", start, F.lit(sample_chars)).alias("text"))
    # Rows that repeat a doc_id with other texts may exceed the bound; the first by draw and content count.
    rows = first_rows(texts.where(F.col("text") != ""), 2 * max(len(picked), 1), "draw", "doc_id", "label")
    return train([(r["text"], r["label"]) for r in rows])


def severity(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected severity, grade and P(grade > 0) of each text."""
    n = len(texts)
    if model is None:
        return np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    rows, buckets, _ = features(texts)
    above = _above(model, rows, buckets, n)
    return above.sum(1), (above >= model.cut).sum(1), above[:, 0]


def _score(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                expected, grade, toxic = severity(model, piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(toxic), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected severity, grade, p_toxic and toxic (a grade above 0) for every row."""
    return docs.select("doc_id", "text").mapInArrow(lean(_score(model)), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
