"""A bounded sample of labelled rows, and fitting small models to it with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import remainder, whole_text

#: The most labelled rows a classifier is fitted on: those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    held_out: int,
    rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(text, y) of at most ``rows`` labelled rows outside the held-out part, one for each id. An id
    labelled more than once counts with its largest label, one with several texts by that with the
    smallest hash; null labels and ids count as none."""
    chosen = (
        labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (remainder("id", parts) != held_out))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(one, F.first("y").alias("y")).select("text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton steps. Without rows, or with
    labels all alike, the weights are 0 and the bias is the smoothed log odds of the label."""
    odds = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(odds)
    if not len(y) or y.min() == y.max():
        return w[:-1], float(w[-1])
    full = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 0.0
    for _ in range(steps):
        p = sigmoid(full @ w)
        slope = full.T @ (y - p) - ridge * w
        curve = (full * (p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T @ full
        w = w + np.clip(np.linalg.solve(curve.astype(np.float64) + np.diag(ridge + 1e-9), slope), -2.0, 2.0)
    return w[:-1], float(w[-1])
