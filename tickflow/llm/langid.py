"""Operator 9: language identification from averaged hashed subword embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches

#: Rows of the embedding table, its width, and the lengths in bytes of the subwords.
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (2, 3, 4)
MIX = np.uint32(0x9E3779B1)


def subwords(text: str) -> np.ndarray:
    """Buckets of all byte n-grams of the lower-cased text, white space folded and one space at each end."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    out, h = [], data
    for n in range(2, max(GRAMS) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :]
        if n in GRAMS:
            out.append(((h + np.uint32(n)) * MIX) >> np.uint32(32 - 15))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # logits that a subword adds, before averaging: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probabilities of the labels."""
        grams = subwords(text)
        logits = self.bias + (self.table[grams].mean(axis=0) if len(grams) else 0.0)
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 7, reject_share: float = 0.01) -> Model | None:
    """Train on (text, language) rows by stochastic gradient descent.

    Every fifth row is held back: the temperature that fits its labels best calibrates the scores, and
    ``reject_below`` is the score under which the lowest ``reject_share`` of its right answers fall.
    """
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    bags = []
    for text, lang in rows:
        grams, counts = np.unique(subwords(text), return_counts=True)
        if len(grams):
            bags.append((grams, (counts / counts.sum()).astype(np.float32), labels.index(lang)))
    held, train = (bags[::5], [b for k, b in enumerate(bags) if k % 5]) if len(bags) >= 20 else (bags, bags)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    # a subword's share of an average is small, so its row moves by a step that is as much larger
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(train)):
            grams, share, y = train[k]
            mean = share @ embed[grams]
            error = softmax(mean @ layer + bias)
            error[y] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            embed[grams] -= step * 20 * share[:, None] * back
    model = Model(labels, embed @ layer, bias, 1.0, 0.0)
    logits = np.array([s @ model.table[g] + bias for g, s, _ in held]).reshape(-1, len(labels))
    truth = np.array([y for *_, y in held], int)
    if len(truth):
        heat = [0.25 * 1.15**k for k in range(30)]
        model.temperature = min(heat, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == truth
        model.reject_below = float(np.quantile(p.max(axis=1)[right], reject_share)) if right.any() else 0.0
    return model


def training_rows(docs: DataFrame, most: int, text_col: str, label_col: str, id_col: str, seed: int = 5, least: int = 50, most_labels: int = 1000) -> list[tuple[str, str]]:
    """Some ``most`` labelled rows with text, and some ``least`` of every rarer label (all if it has fewer).

    Rows are drawn by a hash of their ids and collected in id order.  Only the ``most_labels`` commonest labels
    are drawn from, which bounds the sample.
    """
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col, F.col(label_col).alias("__label"))
    counts = known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__label").limit(most_labels).collect()
    if not counts:
        return []
    total = sum(n for _, n in counts)
    cuts = [(label, int(min(1.0, max(most / total, least / n)) * (1 << 30))) for label, n in counts]
    cuts = docs.sparkSession.createDataFrame(cuts, StructType([StructField("__label", known.schema["__label"].dataType), StructField("__cut", LongType())]))
    drawn = known.join(F.broadcast(cuts), "__label").where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < F.col("__cut"))
    rows = drawn.select(id_col, text_col, "__label").limit(2 * most + 2 * least * len(counts)).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1], str(r[2])))]


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, rejected.

    ``score`` is the calibrated probability of the best language; ``rejected`` says that it is lower than
    those of nearly all right answers in training.  Texts that are null or have no letter, and all texts if
    there was nothing to learn from, are ``und`` with score 0 and rejected.  Whole texts are read; ids may
    be null or repeat; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if not model or not text or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, True))
                    continue
                p = model.scores(text)
                best = int(p.argmax())
                out.append((model.labels[best], float(p[best]), bool(p[best] < model.reject_below)))
            pred, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str, parts: int, part: int):
    """Is the row of the fold that no model learns from?  False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def predicted(docs: DataFrame, most_rows: int = 1500) -> DataFrame:
    """Fit on up to some ``most_rows`` rows outside the held-out fold, then predict every row."""
    model = fit(training_rows(docs.where(~held_out("doc_id", 4, 2)), most_rows, "text", "lang", "doc_id"))
    found = identified(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
