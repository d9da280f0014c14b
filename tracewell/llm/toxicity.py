"""Operator 3, a toxicity classifier with counterfactual regularisation.

A linear model over the presence of words and word beginnings. Labelled texts are cut into sentences, and every sentence that
names a group gives counterfactuals, in which each identity term is exchanged for another of its kind, for each other term in
turn; kinds of fewer terms begin again. The squared change of the model's output between a sentence and its counterfactual is penalised, so that
weight can't rest on the mention itself and neutral mentions aren't marked. Words and sentences are made by tasks; what the
driver learns from is the words of each sampled text and the features that each swap takes and gives.

Parameters: `per_class` bounds the labelled rows of a class (SAMPLE), whose texts are read whole; FEATURES bounds the model.
FEATURES, PENALTY and RIDGE were chosen by cross-validation among rows that the query may learn from (README). Scoring reads
whole texts. Defined cases: null text is empty and scores the intercept; without labelled rows of both classes every text
scores the smoothed share of label 1; a doc_id with both labels teaches nothing; repeated rows score alike; an empty table
gives no rows; extra columns play no part.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import step
from .labelled import remainder, sample

SAMPLE, FEATURES, LEAST_TEXTS, PENALTY, RIDGE, ROUNDS = 2500, 300, 3, 5.0, 1e-4, 250

#: Terms of one row are exchanged for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("american", "german", "french", "spanish", "mexican", "chinese", "indian", "turkish"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)
_ROW = {t: (row, i) for row in IDENTITY_TERMS for i, t in enumerate(row)}
_WORD, _SENTENCE_END = re.compile(r"\w+"), re.compile(r"[.!?\n]+")


def word_features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings of four to six letters with a mark."""
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k))


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def spread(found: set[str]) -> set[str]:
    return {f for w in found for f in word_features(w)}


def other(term: str, k: int) -> str:
    """The k-th other term of its kind."""
    row, i = _ROW[term]
    return row[(i + 1 + k % (len(row) - 1)) % len(row)]


def swaps(text: str | None) -> list[tuple[str, str]]:
    """For each sentence that names a group and each swap, the features that go and those that come, each joined by spaces."""
    out = []
    for sentence in _SENTENCE_END.split(text.lower()) if text else ():
        found = set(_WORD.findall(sentence))
        if found.isdisjoint(_ROW):
            continue
        own = spread(found)
        for k in range(max(len(_ROW[w][0]) for w in found if w in _ROW) - 1):
            new = spread({other(w, k) if w in _ROW else w for w in found})
            if own != new:
                out.append((" ".join(sorted(own - new)), " ".join(sorted(new - own))))
    return list(dict.fromkeys(out))


class ToxicityModel:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[str, tuple[str, ...]] = {}

    def score(self, texts) -> np.ndarray:
        out, weights, memo = np.empty(len(texts)), self.weights, self.memo
        if len(memo) > 300_000:
            memo.clear()
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in words(text):
                if (own := memo.get(w)) is None:
                    own = memo[w] = tuple(f for f in word_features(w) if f in weights)
                if own:
                    found.update(own)
            out[i] = self.bias + sum(map(weights.__getitem__, found))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(rows: list[set[str]], y: np.ndarray, w: np.ndarray, changes: list[tuple[str, str]], features: int = 0, penalty: float = -1, ridge: float = -1) -> bytes:
    """The arguments of a ToxicityModel, pickled, from the words of texts, their labels and weights, and the swaps of their sentences."""
    features, penalty, ridge = features or FEATURES, PENALTY if penalty < 0 else penalty, RIDGE if ridge < 0 else ridge
    prior = float((w @ y + 1) / (w.sum() + 2)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return pickle.dumps(({}, base))
    one: dict[str, str] = {}  # a single object for each word
    rows = [{one.setdefault(x, x) for x in r} for r in rows]
    seen = {0: Counter(), 1: Counter()}
    for r, k in zip(rows, y.tolist(), strict=True):
        seen[k].update(spread(r))
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    gain = {}
    for f in set(seen[0]) | set(seen[1]):
        a, b = seen[1][f], seen[0][f]
        if a + b >= LEAST_TEXTS:
            p, q, all_ = a / n[1], b / n[0], (a + b) / (n[0] + n[1])
            gain[f] = (p - q) ** 2 / (all_ * (1 - all_) + 1e-3)
    names = sorted(gain, key=lambda f: (-gain[f], f))[:features]
    names += [t for t in _ROW if t in gain and t not in set(names)]
    place = {f: i for i, f in enumerate(names)}

    def matrix(sets: list) -> tuple[np.ndarray, np.ndarray]:
        own = [[place[f] for f in r if f in place] for r in sets]
        return np.repeat(np.arange(len(own)), [len(o) for o in own]), np.array([j for o in own for j in o], np.int64)

    r0, c0 = matrix([spread(r) for r in rows])
    pairs = [(a.split(), b.split()) for a, b in changes]
    ra, ca = matrix([a for a, _ in pairs])
    rb, cb = matrix([b for _, b in pairs])
    theta, bias, m, v = np.zeros(len(names)), base, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    u = w / w.sum()
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(r0, theta[c0], len(rows))
        g = u * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(c0, g[r0], len(names)) + ridge * theta
        if pairs:  # the counterfactual term: d/dtheta of penalty * mean((z - z')^2)
            gap = np.bincount(ra, theta[ca], len(pairs)) - np.bincount(rb, theta[cb], len(pairs))
            gap = gap * (2 * penalty / len(pairs))  # counts of nothing are integers
            grad += np.bincount(ca, gap[ra], len(names)) - np.bincount(cb, gap[rb], len(names))
        grad = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        theta, bias = theta - move[:-1], bias - move[-1]
    return pickle.dumps(({f: float(t) for f, t in zip(names, theta, strict=True) if abs(t) > 1e-3}, float(bias)))


@functools.lru_cache(maxsize=2)
def _model(model: bytes) -> ToxicityModel:
    return ToxicityModel(*pickle.loads(model))


def scorer(model: bytes):
    """A column function from texts to scores."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_model(model).score(texts.tolist()))

    return score


def learned(docs: DataFrame, labels: DataFrame, learn, per_class: int = SAMPLE) -> tuple[list[set[str]], np.ndarray, np.ndarray, list[tuple[str, str]]]:
    """What `train` takes: words of the sampled texts, labels, weights, swaps; in the order of the sample."""

    def run(batches):
        for part in batches:
            own = [swaps(t) for t in part["text"]]
            yield pd.DataFrame({"place": part["place"], "doc_id": part["doc_id"], "y": part["y"].astype("int32"), "words": [" ".join(sorted(words(t))) for t in part["text"]], "swaps": ["\n".join("\t".join(x) for x in s) for s in own]})

    with step(docs.sparkSession):
        rows, weights = sample(docs, labels, "toxic", learn, per_class)
        found = sorted(map(tuple, rows.mapInPandas(run, "place long, doc_id long, y int, words string, swaps string").collect()))
    y = np.array([r[2] for r in found], np.int64)
    changes = [tuple(x.split("\t")) for r in found for x in r[4].split("\n") if x]
    return [set(r[3].split(" ")) - {""} for r in found], y, np.array([weights[k] for k in y.tolist()], float), changes


def fit(docs: DataFrame, labels: DataFrame, learn, per_class: int = SAMPLE) -> bytes:
    return train(*learned(docs, labels, learn, per_class))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; every fifth label, by crc32, is held out."""
    held = remainder("doc_id", 5) == 0
    score = scorer(fit(docs, labels, ~held))
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
