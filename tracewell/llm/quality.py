"""Operator 9, a quality classifier by compression.

Zstandard dictionaries are trained on good and on bad labelled texts, several pairs from disjoint parts of the sample, each in
a task of its own. A text is compressed piece by piece, the whole of it, with each dictionary; what the bad dictionary needs
more than the good one, over the bytes of the text and averaged over the pairs, is the evidence. A logistic regression on
labelled texts that no dictionary has seen calibrates it into a score.

Parameters: `per_class` bounds the labelled rows of a class (SAMPLE), whose texts are read whole; scoring has no bounds.
Defined cases: null text is empty, and the empty text has an evidence of 0; where the sample has too few rows of a class for
dictionaries, every text scores the smoothed share of label 1; a doc_id with both labels teaches nothing; repeated rows score
alike; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import give_back, step
from .labelled import newton_logistic, remainder, sample

SAMPLE, PAIRS, PIECE, DICTIONARY, LEVEL = 4000, 3, 1024, 112_640, 3


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)] or [b""]


class CompressionScorer:
    """Scores of texts; `pairs` are (good, bad) dictionaries, `theta` the calibration of the standardised evidence."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], mean: float, scale: float, theta: np.ndarray, prior: float):
        self.mean, self.scale, self.theta, self.prior = mean, scale, theta, prior
        self.coders = [tuple(self._coder(d) for d in pair) for pair in pairs]

    @staticmethod
    def _coder(dictionary: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False)

    def evidence(self, text: str | None) -> float:
        raw = (text or "").encode()
        pieces = _pieces(raw)
        more = sum(len(bad.compress(p)) - len(good.compress(p)) for good, bad in self.coders for p in pieces)
        return more / (len(self.coders) * max(1, len(raw))) if raw else 0.0

    def score(self, texts) -> np.ndarray:
        if not self.coders:
            return np.full(len(texts), self.prior)
        x = (np.array([self.evidence(t) for t in texts], float) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.theta[0] + x * self.theta[1], -30, 30)))


def dictionary(texts: list[str]) -> bytes | None:
    """A dictionary of whole texts; None where they are too few."""
    pieces = [p for t in texts for p in _pieces(t.encode())]
    if len(pieces) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return None


def _trained(part: pd.DataFrame) -> pd.DataFrame:
    own = part.sort_values(["place", "doc_id"])
    return pd.DataFrame({"y": own["y"].iloc[:1].astype("int32"), "part": own["part"].iloc[:1], "dictionary": [dictionary(own["text"].tolist())]})


def fit(docs: DataFrame, labels: DataFrame, learn, per_class: int = SAMPLE) -> bytes:
    """The arguments of a CompressionScorer, pickled. The driver sees dictionaries and numbers, no texts."""
    with step(docs.sparkSession):
        rows, weights = sample(docs, labels, "quality", learn, per_class)
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = sum(weights[y] * n[y] for y in n)
        prior = float((weights.get(1, 0) * n.get(1, 0) + 1) / (held + 2)) if n else 0.5
        nothing = pickle.dumps(([], 0.0, 1.0, np.zeros(2), prior))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("place", F.lit(1)), F.lit(PAIRS + 1)).cast("int"))
        made = dealt.filter(F.col("part") < PAIRS).groupBy("y", "part").applyInPandas(_trained, "y int, part int, dictionary binary").collect()
        found = {(r["y"], r["part"]): bytes(r["dictionary"]) for r in made if r["dictionary"] is not None}
        pairs = [(found[1, i], found[0, i]) for i in range(PAIRS) if (1, i) in found and (0, i) in found]
        if not pairs:
            return nothing
        raw = pickle.dumps((pairs, 0.0, 1.0, np.zeros(2), prior))

        @pandas_udf(DoubleType())
        def evidence(texts: pd.Series) -> pd.Series:
            return pd.Series([_scorer(raw).evidence(t) for t in texts])

        fresh = dealt.filter(F.col("part") == PAIRS).select("y", "place", evidence("text").alias("x")).collect()
    fresh.sort(key=lambda r: (r["place"], r["y"], r["x"]))
    x, y = np.array([r["x"] for r in fresh]), np.array([r["y"] for r in fresh], np.int64)
    if len(set(y.tolist())) < 2:
        return nothing
    mean, scale = float(x.mean()), float(x.std()) + 1e-9
    theta = newton_logistic(((x - mean) / scale)[:, None], y, np.array([weights[k] for k in y.tolist()]))
    return pickle.dumps((pairs, mean, scale, theta, prior))


@functools.lru_cache(maxsize=1)
def _scorer(model: bytes) -> CompressionScorer:
    return CompressionScorer(*pickle.loads(model))


def scorer(model: bytes):
    """A column function from texts to scores."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(_scorer(model).score(texts.tolist()))
        give_back()
        return out

    return score


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; every third label, by crc32, is held out."""
    held = remainder("doc_id", 3) == 1
    score = scorer(fit(docs, labels, ~held))
    out = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
