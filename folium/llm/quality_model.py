"""Operator 1: quality classifier, a factorisation machine over sparse features.

Features of a text: hashed words (lower-cased, value proportional to the square root
of their count), structure statistics (shares of capitals, symbols, digits, repeated
words and lines, ...) and metadata of the text (length, lines, share of bytes beyond
ASCII), the latter two cut into steps of which each is a feature.  The pairwise term is
scored in time linear in the features by the sum-of-squares identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

The model is fitted on the driver on a bounded sample (``PER_CLASS`` rows of either
label, never a held-out one) and scores every whole text in Arrow batches.  Labels,
language, source and id are no inputs.

Defined cases: null and empty texts have the metadata and structure features of an
empty text and get a score; without rows of both labels the score is the smoothed
share of label 1; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import held_out, text_of, training_rows

#: Labelled rows of either class that the model is fitted on, at most.
PER_CLASS = 1500
BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.5

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _PIPE, _PUNCT, _HIGH, _SPACE = range(9)


def _byte_classes() -> np.ndarray:
    kind = np.zeros((256, 9), dtype=np.float64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b, _HIGH] = 1
        elif c.isupper():
            kind[b, _UPPER] = 1
        elif c.islower():
            kind[b, _LOWER] = 1
        elif c.isdigit():
            kind[b, _DIGIT] = 1
        elif c in "#*$%&<>@^~=+\\/_[]{}":
            kind[b, _SYMBOL] = 1
        elif c in "!?":
            kind[b, _BANG] = 1
        elif c == "|":
            kind[b, _PIPE] = 1
        elif c.isspace():
            kind[b, _SPACE] = 1
        else:
            kind[b, _PUNCT] = 1
    return kind


_KINDS = _byte_classes()
#: Steps that cut each statistic; the last four are metadata.
CUTS = {
    "upper": (0.001, 0.02, 0.06, 0.15, 0.4),
    "digit": (0.001, 0.01, 0.05, 0.15),
    "symbol": (0.0005, 0.005, 0.02, 0.08),
    "bang": (0.0005, 0.005, 0.02, 0.08),
    "pipe": (0.0005, 0.005, 0.02, 0.08),
    "punct": (0.005, 0.02, 0.04, 0.08, 0.15),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "distinct_words": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9),
    "distinct_pairs": (0.1, 0.3, 0.5, 0.7, 0.85, 0.95, 0.99),
    "same_next": (0.005, 0.02, 0.1, 0.3, 0.7),
    "distinct_lines": (0.2, 0.5, 0.8, 0.95, 0.999),
    "line_words": (3, 6, 12, 25, 50, 100),
    "chars": (20, 60, 150, 400, 1000, 2500, 6000, 20000),
    "lines": (1.5, 3.5, 8.5, 20.5, 60.5),
    "high": (0.001, 0.02, 0.06, 0.12, 0.3),
    "words": (5, 15, 50, 150, 500, 2000),
}
_OFFSETS, _at = {}, BUCKETS
for _name, _cuts in CUTS.items():
    _OFFSETS[_name] = _at
    _at += len(_cuts) + 1
FEATURES = _at


class _Memo(dict):
    """Checksums of words, lower-cased; cleared when full, so its memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        return found


class Featuriser:
    """Sparse features of texts."""

    def __init__(self):
        self.memo = _Memo()

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = text.split()
        n = len(words)
        ids = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=n)
        distinct, counts = np.unique(ids, return_counts=True)
        pairs = np.sort(ids[:-1] * 0x9E3779B1 ^ ids[1:])
        kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _KINDS
        share = kinds / max(1, len(raw) - kinds[_SPACE])
        lines = [x for x in text.split("\n") if x]
        stats = (
            share[_UPPER],
            share[_DIGIT],
            share[_SYMBOL],
            share[_BANG],
            share[_PIPE],
            share[_PUNCT],
            (len(raw) - kinds[_SPACE]) / max(1, n),
            len(distinct) / max(1, n),
            (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / max(1, n - 1),
            np.count_nonzero(ids[1:] == ids[:-1]) / max(1, n - 1),
            len(set(lines)) / max(1, len(lines)),
            n / max(1, len(lines)),
            len(text),
            len(lines),
            share[_HIGH],
            n,
        )
        fixed = [_OFFSETS[k] + bisect_left(CUTS[k], v) for k, v in zip(CUTS, stats, strict=True)]
        val = np.sqrt(counts)
        norm = math.sqrt(n) or 1.0  # the values' squares are the counts
        return np.concatenate([distinct % BUCKETS, fixed]), np.concatenate([val / norm, np.full(len(fixed), 0.5)])

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, values and the start of each row; no row is empty."""
        rows = [self.row(t) for t in texts]
        starts = np.cumsum([0, *(len(r[0]) for r in rows)])[:-1]
        return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts


class FactorisationMachine:
    """Weights w0, w and factors v; ``constant`` where there was nothing to learn from."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, constant: float | None = None):
        self.w0, self.w, self.v, self.constant = w0, w, v, constant

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums, squares = self._sums(idx, val, starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (sums**2 - squares).sum(axis=1)

    def _sums(self, idx, val, starts):
        vx = self.v[idx] * val[:, None]
        return np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx**2, starts, axis=0)

    def score(self, features: Featuriser, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(*features.batch(texts)), -30, 30)))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, factors: int = FACTORS, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss, both classes weighing the same; numpy only."""
    y = np.array([r[1] for r in rows], dtype=np.float64)
    v = np.random.default_rng(seed).normal(0, 0.05, (FEATURES, factors))
    if len(set(y)) < 2:
        return FactorisationMachine(0.0, np.zeros(FEATURES), v, float((y.sum() + 1) / (len(y) + 2)))
    idx, val, starts = Featuriser().batch([r[0] for r in rows])
    ends = np.append(starts[1:], len(idx))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    model = FactorisationMachine(0.0, np.zeros(FEATURES), v)
    rng, size = np.random.default_rng(seed), 256
    first = [0.0, np.zeros(FEATURES), np.zeros_like(v)]
    second = [0.0, np.zeros(FEATURES), np.zeros_like(v)]
    step, rate, decay = 0, 0.02, 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            pick = order[at : at + size]
            lengths = ends[pick] - starts[pick]
            begin = np.cumsum([0, *lengths])[:-1]
            take = np.repeat(starts[pick] - begin, lengths) + np.arange(lengths.sum())
            i, x, of = idx[take], val[take], np.repeat(np.arange(len(pick)), lengths)
            sums, squares = model._sums(i, x, begin)
            raw = model.w0 + np.add.reduceat(model.w[i] * x, begin) + 0.5 * (sums**2 - squares).sum(axis=1)
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
            gx = g[of] * x
            inner = sums[of] - model.v[i] * x[:, None]
            grads = [
                g.sum(),
                np.bincount(i, weights=gx, minlength=FEATURES) + decay * model.w,
                np.stack([np.bincount(i, weights=gx * inner[:, f], minlength=FEATURES) for f in range(factors)], axis=1)
                + decay * model.v,
            ]
            step += 1
            moved = []
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                moved.append(rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            model.w0 -= moved[0]
            model.w = model.w - moved[1]
            model.v = model.v - moved[2]
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col="doc_id", text_col="text") -> FactorisationMachine:
    return fit(training_rows(docs, labels, "quality", per_class, id_col, text_col))


def score_column(spark: SparkSession, model: FactorisationMachine, text_col: str = "text") -> Column:
    """The score of a text column as an expression."""
    shared = spark.sparkContext.broadcast((model.w0, model.w, model.v, model.constant))
    features = None

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        nonlocal features
        if features is None:
            features = Featuriser()
        return pd.Series(FactorisationMachine(*shared.value).score(features, texts.tolist()))

    return score(text_of(text_col))


def classify(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row. No shuffle."""
    scored = docs.select(F.col(id_col).alias("_id"), score_column(docs.sparkSession, model, text_col).alias("score"))
    return scored.select(
        F.col("_id").alias(id_col),
        held_out("_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
