"""Language identification in two steps: family first, then the languages of that family.

Texts are lower-cased; every letter trigram and bigram of a text (with word ends) is hashed to a
table. A linear support vector machine is trained for each pair of families and, within a
family, for each pair of languages; the votes of the pairs decide, margins break ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: ISO 639-1 codes by family: fixed values. Any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "am", "mt"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "pa", "gu"],
    "uralic": ["fi", "et", "hu"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BITS = 14
#: Texts per language that train the machines, those with the smallest hash of id and text.
SAMPLE = 1500
EPOCHS = 12
COST = 10.0
UNKNOWN = "und"


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams and bigrams of the lower-cased letters; other characters are gaps."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    b = np.where(letter, raw, 32).astype(np.uint32)
    b = b[(b != 32) | np.concatenate([[True], b[:-1] != 32])]
    if len(b) < 3:
        return np.empty(0, np.int64)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    shift = np.uint32(32 - BITS)
    return np.concatenate([two * np.uint32(2654435761) >> shift,
                           (three + np.uint32(1)) * np.uint32(2246822519) >> shift]).astype(np.int64)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the unit vector of square roots of gram shares."""
    counts = np.bincount(grams(text), minlength=1 << BITS)
    at = np.nonzero(counts)[0]
    return at, np.sqrt(counts[at] / max(1, counts.sum()))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_pair(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> np.ndarray:
    """Linear SVM (hinge loss, dual coordinate descent); the last weight is the bias."""
    w = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(rows))
    weight = np.where(signs > 0, len(rows) / max(1, 2 * (signs > 0).sum()),
                      len(rows) / max(1, 2 * (signs < 0).sum()))
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            gradient = signs[i] * (w[at] @ x + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), COST * weight[i])   # |x|^2 + 1 = 2
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """Weights per pair: (level, first, second). Level is "" for families, else the family."""

    def __init__(self, languages: list[str]):
        self.languages = sorted(languages)
        self.families = sorted({family(x) for x in languages})
        self.pairs: list[tuple[str, str, str]] = []
        self.weights = np.zeros((0, (1 << BITS) + 1))

    def members(self, level: str) -> list[str]:
        return self.families if level == "" else [x for x in self.languages if family(x) == level]

    def all_pairs(self):
        for level in ["", *self.families]:
            names = self.members(level)
            for i, a in enumerate(names):
                for b in names[i + 1:]:
                    yield level, a, b

    def choose(self, level: str, margins: dict) -> tuple[str, float]:
        names = self.members(level)
        if len(names) == 1:
            return names[0], 1.0
        votes = {n: [0, 0.0] for n in names}
        for (lv, a, b), m in margins.items():
            if lv == level:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(names, key=lambda n: votes[n])
        own = [m if a == best else -m for (lv, a, b), m in margins.items()
               if lv == level and best in (a, b)]
        return best, float(1 / (1 + np.exp(-np.clip(3 * min(own), -30, 30))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = vector(text)
        values = self.weights[:, at] @ x + self.weights[:, -1] if len(at) else self.weights[:, -1]
        margins = dict(zip(self.pairs, values))
        group, p = self.choose("", margins)
        lang, q = self.choose(group, margins)
        return lang, round(float(p * q), 6)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """``rows`` (text, lang): at most ``sample`` texts per language train (a documented bound).

    Rows with a null language or a text without letters are left out. The machines are trained
    in tasks, one per pair; a task sees the sample of its two classes, split evenly over the
    languages of a family. Without rows, every prediction is ``und``.
    """
    usable = rows.filter("lang is not null and text is not null").filter(
        F.col("text").rlike(r"\p{L}"))
    # Two levels: a language may hold most rows, so each slice is ranked first.
    slices = Window.partitionBy("lang", "slice").orderBy("h")
    keyed = usable.select("lang", F.xxhash64("text").alias("h")).distinct()
    least = keyed.withColumn("slice", F.pmod(F.shiftright("h", 8), F.lit(256))).withColumn(
        "r", F.row_number().over(slices)).filter(F.col("r") <= sample)
    chosen = least.withColumn("r", F.row_number().over(
        Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample).select("lang", "h")
    limits = {r["lang"]: r["h"] for r in chosen.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    model = Model(list(limits))
    if not limits:
        return model
    model.pairs = list(model.all_pairs())
    below = F.lit(False)
    for lang, h in limits.items():
        below = below | ((F.col("lang") == lang) & (F.xxhash64("text") <= h))
    sampled = usable.filter(below).select("lang", "text").dropDuplicates()
    if not model.pairs:
        return model
    names = F.create_map(*[F.lit(x) for lang in limits for x in (lang, family(lang))])
    pair = F.explode(F.array(*[F.when(
        (F.col("lang").isin(a, b) if level else F.element_at(names, F.col("lang")).isin(a, b)), i)
        for i, (level, a, b) in enumerate(model.pairs)])).alias("pair")
    pairs, plain = model.pairs, family

    def train(group: pd.DataFrame) -> pd.DataFrame:
        level, a, _ = pairs[int(group["pair"].iloc[0])]
        group = group.sort_values(["lang", "text"])
        vectors = [vector(t) for t in group["text"]]
        side = group["lang"] if level else group["lang"].map(plain)
        w = train_pair(vectors, np.where(side == a, 1.0, -1.0))
        return pd.DataFrame({"pair": [group["pair"].iloc[0]], "w": [w.tolist()]})

    trained = sampled.select(pair, "lang", "text").filter("pair is not null").groupBy(
        "pair").applyInPandas(train, "pair int, w array<double>").collect()   # one row per pair
    model.weights = np.zeros((len(pairs), (1 << BITS) + 1))
    for row in trained:
        model.weights[row["pair"]] = row["w"]
    return model


def predict(model: Model, text: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column; null or without a letter: ``und``, 0."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])
    return F.pandas_udf(run, "lang_pred string, score double")(text)
