"""Operator 12: text quality by learning from trusted positives and unlabelled text.

The classifier minimises the non-negative unbiased risk (Kiryo et al. 2017): the loss of positives, weighted by
the class prior, and what the unlabelled rows lose as negatives beyond the share of positives among them, which
may not fall below zero.  The prior is estimated from how often both kinds score above a cut (Garg et al. 2021).
"""

from __future__ import annotations

import operator
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .langid import held_out

#: Classes of characters: letters by case, digits, space, line end, stops, other marks, symbols, the rest.
CLASSES = 12
_LISTED = {" ": 3, "\t": 3, "\n": 4, "\r": 4, ".": 5, ",": 6, "!": 7, "?": 7, "-": 8, "'": 8, '"': 8, "(": 8, ")": 8, ":": 8, ";": 8}
_BY_CATEGORY = {"Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 4, "Zp": 4, "Pd": 8, "Ps": 8, "Pe": 8, "Pi": 8, "Pf": 8, "Pc": 9, "Po": 9, "Sm": 10, "Sc": 10, "Sk": 10, "So": 10, "Cc": 11, "Cf": 11, "Co": 11, "Cs": 11, "Cn": 11}
#: Code points whose class is looked up; later ones count as lower-case letters.
KNOWN = 0x3000
STATISTICS = 10
FEATURES = CLASSES * CLASSES + STATISTICS


def _class_table() -> np.ndarray:
    return np.array([_LISTED.get(chr(c), _BY_CATEGORY.get(unicodedata.category(chr(c)), 0)) for c in range(KNOWN)] + [0], np.uint8)


_TABLE = _class_table()


def features(text: str) -> np.ndarray:
    """Square roots of the shares of pairs of neighbouring character classes, and statistics of words and lines; of the whole text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    classes = _TABLE[np.minimum(points, KNOWN)]
    pairs = np.bincount(classes[:-1] * np.uint8(CLASSES) + classes[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(points) - 1))
    words, lines = text.split(), text.split("\n")
    if words:
        n, counts = len(words), Counter(words)
        # windows of words: how much is said again close by
        near = [len(set(words[k : k + 64])) / min(64, n - k) for k in range(0, n, 64)]
        out[CLASSES * CLASSES :] = (
            np.log1p(n), sum(map(len, words)) / n, np.log(max(map(len, words))), max(counts.values()) / n, sum(map(operator.eq, words, words[1:])) / n,
            len(counts) / n, sum(near) / len(near), min(near), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        )
    return out


# --- learning -----------------------------------------------------------------------------------------------


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of a margin."""
    return np.logaddexp(0.0, -z)


def _slope(z: np.ndarray) -> np.ndarray:
    return -1 / (1 + np.exp(np.clip(z, -30, 30)))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-3, batch: int = 256, seed: int = 11) -> np.ndarray:
    """Weights (the last one a constant) that minimise the non-negative risk of two samples, by Adam over batches."""
    rng = np.random.default_rng(seed)
    x, u = np.c_[positive, np.ones(len(positive))], np.c_[unlabelled, np.ones(len(unlabelled))]
    weights = np.zeros(x.shape[1])
    first, second, t = np.zeros_like(weights), np.zeros_like(weights), 0
    steps = max(1, len(u) // batch)
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(u)), steps):
            b, a = u[part], x[rng.integers(len(x), size=min(len(x), batch))]
            za, zb = a @ weights, b @ weights
            as_negative = _loss(-zb).mean() - prior * _loss(-za).mean()
            back = -b.T @ _slope(-zb) / len(b) + prior * a.T @ _slope(-za) / len(a)
            # a negative part below zero is overfitting: step back from it
            grad = prior * a.T @ _slope(za) / len(a) + back if as_negative >= 0 else -back
            grad = grad + decay * np.r_[weights[:-1], 0]
            t += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            weights = weights - rate * (1 - epoch / epochs) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.01, doubt: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores of held-back rows of both.

    Above a cut that only positives pass, the shares of both kinds that pass are in the ratio of the prior.
    The cut is the one with the least ratio plus what chance may add to it.
    """
    cuts = np.unique(np.r_[positive, unlabelled])
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    chance = np.sqrt(np.log(4 / doubt) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / doubt) / 2 / len(positive))
    ok = above_p > 0
    best = np.argmin(above_u[ok] / above_p[ok] + (1 + slack) / above_p[ok] * chance)
    return float(np.clip(above_u[ok][best] / above_p[ok][best], 0.01, 0.99))


@dataclass
class Model:
    weights: np.ndarray | None
    middle: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of good quality of each row of features."""
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _calibration(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift that fit the labels best if ``share`` of all rows are positive; the slope stays positive."""
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        h, e = weight * p * (1 - p), weight * (p - y)
        grad = np.array([e @ z + 1e-4 * (slope - 1), e.sum()])
        hess = np.array([[h @ z**2 + 1e-4, h @ z], [h @ z, h.sum() + 1e-6]])
        d = np.linalg.solve(hess, grad)
        d *= min(1.0, 1.0 / np.abs(d).max()) if d.any() else 1.0
        slope, shift = max(1e-3, slope - d[0]), shift - d[1]
    return slope, shift


def fit(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray, share: float, seed: int = 13) -> Model:
    """Weights from positives and unlabelled rows; known negatives only set where the score stands at one half.

    ``share`` is that of positives among labelled rows; it is the score of everything if there is too little to learn.
    """
    blank = np.zeros(FEATURES)
    if len(positive) < 10 or len(unlabelled) < 10:
        return Model(None, blank, blank + 1, prior=share)
    rng = np.random.default_rng(seed)
    positive, unlabelled = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    model = Model(None, unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3)
    z = [np.clip((x - model.middle) / model.scale, -8, 8) for x in (positive, unlabelled)]
    # a classifier of positives against unlabelled rows orders both for the estimate of the prior
    apart = non_negative_risk(z[0][::2], z[1][::2], 0.5, epochs=20)
    prior = estimated_prior(*[np.c_[x[1::2], np.ones(len(x[1::2]))] @ apart for x in z])
    model.prior = prior
    model.weights = non_negative_risk(z[0], z[1], prior)
    if len(negative) >= 10:
        margins = np.r_[model.margin(positive), model.margin(negative)]
        model.slope, model.shift = _calibration(margins, np.r_[np.ones(len(positive)), np.zeros(len(negative))], share)
    return model


# --- on tables ----------------------------------------------------------------------------------------------


def _features_of(docs: DataFrame, most: int, text_col: str) -> np.ndarray:
    """Features of up to ``most`` documents, computed in tasks; only they come to the driver."""

    def run(batches):
        for batch in batches:
            rows = [features(t or "").astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(rows, pa.binary())], ["id", "x"])

    found = docs.mapInArrow(run, "id string, x binary").limit(most).collect()
    rows = sorted((r[0] or "", bytes(r[1])) for r in found)
    return np.array([np.frombuffer(x, np.float32) for _, x in rows], float).reshape(-1, FEATURES)


def learned(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_unlabelled: int = 6000, most_negative: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on bounded samples of rows outside the held-out fold, drawn by a hash of their ids.

    Positives are labelled 1; unlabelled rows are drawn from all documents, whatever their label; rows labelled 0
    are read for the calibration alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null").where(~held_out("doc_id", 5, 0))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(~held_out("doc_id", 5, 0))
    n = dict(known.groupBy("label").count().collect())

    def drawn(rows: DataFrame, most: int, of: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(min(1.0, most / max(1, of)) * (1 << 30)))

    def labelled(label: int, most: int) -> np.ndarray:
        ids = drawn(known.where(F.col("label") == label), most, n.get(label, 0)).select("doc_id").distinct().limit(2 * most)
        return _features_of(texts.join(F.broadcast(ids), "doc_id"), 2 * most, "text")

    unlabelled = _features_of(drawn(texts, most_unlabelled, texts.count()), 2 * most_unlabelled, "text")
    share = n.get(1, 0) / max(1, sum(n.values()))
    return fit(labelled(1, most_positive), unlabelled, labelled(0, most_negative), share)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted (1 from ``threshold`` on).

    Null texts count as empty, which is a row of zero features; with nothing to learn from every score is the
    share of good rows among labelled ones.  Whole texts are read; ids may be null or repeat; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from rows outside the held-out fold, then score every row."""
    return scored(docs, learned(docs, labels)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
