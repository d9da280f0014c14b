"""Bounded samples of labelled rows, and logistic regression in numpy, for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved


def remainder(column: str, divisor: int):
    """crc32 of the column as text, modulo `divisor`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """A table (doc_id, y, place, text) of at most `per_class` labelled rows of each class where `learn` holds, and class weights.

    Rows are taken in the order of a hash of doc_id, `place`; texts are whole. The weights restore the shares of the classes
    among all such labels. Null texts count as empty; labels other than 0 and 1 teach nothing, nor do doc_ids with both; of
    texts that repeat a doc_id, that with the smallest hash teaches.
    """
    marked = lean(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    marked = marked.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).filter("y = other").select("doc_id", "y", F.xxhash64("doc_id").alias("place"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [marked.filter(F.col("y") == y).orderBy("place", "doc_id").limit(per_class) for y in (0, 1)]
    rows = lean(docs, "doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # 2 * per_class ids at most
    text = F.coalesce("text", F.lit(""))
    rows = saved(rows.groupBy("doc_id", "y", "place").agg(F.min_by(text, F.xxhash64(text)).alias("text")), "labelled-texts")
    held = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.get(y, 0) for y in held) or 1
    return rows, {y: counts[y] / n * sum(held.values()) / total for y, n in held.items()}


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Coefficients, intercept first, of a weighted ridge logistic regression with few columns."""
    a = np.c_[np.ones(len(x)), x]
    theta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return theta
