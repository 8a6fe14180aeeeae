"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of a whole text (lengths, shares of kinds of characters, repetition, word shapes) are
standardised and mapped by random Fourier features, which approximate a Gaussian kernel. The
normal equations of ridge regression are sums over rows: each partition adds up its part, Spark
adds up the parts, and a small system is solved. Raw scores are calibrated by isotonic regression
on a histogram of fixed size. All labelled rows are used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

FEATURES = 128
RIDGE = 2.0           # matters where labels are few
BANDWIDTH = 4.0       # standard deviations
BINS = 512
SEED = 7

_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def statistics(body: bytes) -> list[float]:
    """Numbers that describe a text; shares are of its bytes or words, counts are logarithms."""
    words = body.split()
    n, m = max(1, len(body)), max(1, len(words))
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    lines = [x for x in body.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    marks = sum(map(int, counts[list(b"#$%&*|!{}[]<>=\\^~_")]))
    return [
        np.log1p(len(body)), np.log1p(len(words)), np.log1p(len(lines)),
        float(counts[_LETTER == 1].sum()) / n, float(counts[65:91].sum()) / n,
        float(counts[48:58].sum()) / n, marks / n,
        float(counts[list(b".,;:?'\"")].sum()) / n, float(counts[list(b"|")].sum()) / n,
        float(counts[33]) / n, float(lengths.mean()), float(lengths.std()),
        distinct / m, pairs / m, np.log1p(m / max(1, distinct)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(words, words[1:])) / m,
        sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:") / m,
    ]


NAMES = 18


def _stats_of(texts: pd.Series) -> np.ndarray:
    rows = [statistics((t or "").encode()) for t in texts]
    return np.array(rows, np.float64).reshape(-1, NAMES)


class Model:
    """Standardisation, Fourier features, ridge weights and calibration steps: a few kilobytes."""

    def __init__(self, mean, scale):
        self.mean, self.scale = np.array(mean), np.array(scale)
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(0, 1 / BANDWIDTH, (NAMES, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta, self.low, self.high, self.steps = None, 0.0, 1.0, None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def bins(self, raw: np.ndarray) -> np.ndarray:
        part = (raw - self.low) / max(1e-12, self.high - self.low)
        return np.clip((part * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), self.steps[0])
        return np.round(self.steps[self.bins(self.raw(stats))], 6)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the best ascending shares of ``good`` in ``total`` per bin."""
    stack: list[list[float]] = []
    for g, t in zip(good, total):
        stack.append([float(g), float(t), 1])
        while len(stack) > 1 and (stack[-1][1] == 0 or stack[-2][1] == 0
                                  or stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]):
            g2, t2, k2 = stack.pop()
            stack[-1] = [stack[-1][0] + g2, stack[-1][1] + t2, stack[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / t if t else 0.5) for g, t, k in stack])


def stats(text: str = "text") -> Column:
    """Statistics of a text column as an array; null counts as empty."""
    return F.pandas_udf(lambda t: pd.Series(list(_stats_of(t))), "array<double>")(text)


def fit(rows: DataFrame) -> Model:
    """``rows`` (stats, label 0 or 1): every row counts. Without rows every score is 0.5.

    Three passes: mean and deviation, normal equations, histogram of raw scores. Each returns
    a result of fixed size. Rows with a null label are left out. With one label only, every
    score is that label. Scores are rounded, so the order of sums does not show.
    """
    rows = cut(rows.filter("label is not null").select(
        "stats", F.col("label").cast("double").alias("label")))
    each = [F.col("stats")[i] for i in range(NAMES)]
    first = rows.agg(F.count(F.lit(1)), F.avg("label"), *[F.avg(c) for c in each],
                     *[F.stddev_pop(c) for c in each]).first()
    n = first[0]
    model = Model(np.zeros(NAMES), np.ones(NAMES))
    if not n or first[1] in (0.0, 1.0):
        model.steps = np.full(BINS, 0.5 if not n else first[1])
        return model
    model = Model(np.round(first[2:2 + NAMES], 9),
                  np.maximum(np.round(first[2 + NAMES:], 9), 1e-6))

    def equations(batches):
        size = FEATURES + 1
        left, right, seen = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            stats = np.array(batch.column(0).to_pylist()).reshape(-1, NAMES)
            x, y = model.features(stats), np.asarray(batch.column(1))
            left += x.T @ x
            right += x.T @ y
            seen = True
        if seen:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, np.arange(size)])),
                 pa.array(np.concatenate([j, np.full(size, -1)])),
                 pa.array(np.concatenate([left[i, j], right]))], names=["i", "j", "v"])

    sums = rows.mapInArrow(equations, "i long, j long, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v")).collect()     # (FEATURES + 1) * (FEATURES + 4) / 2 rows at any size
    left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for i, j, v in sums:
        if j < 0:
            right[i] = v
        else:
            left[i, j] = left[j, i] = v
    model.beta = np.linalg.solve(left + RIDGE * np.eye(FEATURES + 1), right)
    raw = F.pandas_udf(lambda s: pd.Series(model.raw(np.stack(s))), "double")
    scored = rows.select(raw("stats").alias("raw"), "label")
    model.low, model.high = scored.agg(F.min("raw"), F.max("raw")).first()
    place = F.pandas_udf(lambda r: pd.Series(model.bins(r.to_numpy())), "long")
    good, total = np.zeros(BINS), np.zeros(BINS)
    for b, g, t in scored.groupBy(place("raw").alias("b")).agg(
            F.sum("label"), F.count(F.lit(1))).collect():    # at most BINS rows
        good[b], total[b] = g, t
    model.steps = isotonic(good, total)
    return model


def score(model: Model, text: str = "text") -> Column:
    """Score of a text column: 0 to 1, higher where label 1 is likelier; null counts as empty."""
    return F.pandas_udf(lambda t: pd.Series(model.score(_stats_of(t))), "double")(text)


def score_of_stats(model: Model) -> Column:
    """The same from the column stats."""
    return F.pandas_udf(lambda s: pd.Series(model.score(np.stack(s))), "double")("stats")
