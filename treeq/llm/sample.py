"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeq.llm.common import Scratch, tidy

#: Hashed terms are numbers below this; a model is a fixed number of arrays of this length.
DIMS = 1 << 20
#: Labelled documents that a classifier is fitted on at most, and the terms in all of them.
MAX_LABELLED, MAX_TERMS = 16_000, 1 << 23
#: Entries of a worker's memory of words; it is emptied when full.
MEMO = 100_000


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (DIMS - 1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, trainable: Column, terms, most: int = MAX_LABELLED, total: int = MAX_TERMS):
    """``(indptr, indices, y)`` of up to ``most`` labelled documents in a sparse layout.

    ``labels`` are chosen in the order of a hash of their id, so the sample doesn't
    depend on partitions; their ids are few enough to broadcast, so no text moves.
    ``terms`` maps a text to its distinct hashed terms. Documents are whole; in that
    order, they stop before all their terms come to over ``total``, which bounds what
    the driver receives. Of different texts of one id, the one of least hash counts.
    """

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        found = pd.Series([np.asarray(terms(t), dtype=np.int32) for t in texts])
        tidy()
        return found

    scratch = Scratch(docs.sparkSession, "sample")
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    chosen = (
        labels.filter(trainable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .orderBy(order, "y")
        .limit(most)
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # ``most`` rows at most
    rows = rows.select("id", "y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), hashed("text").alias("terms"))
    rows = scratch.save(rows.groupBy("id").agg(F.max("y").alias("y"), F.min_by("terms", "th").alias("terms")).withColumn("order", order), "terms")
    sizes = rows.select("order", F.size("terms").alias("n")).orderBy("order").toArrow()  # ``most`` rows at most
    fits = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy().astype(np.int64)), total, side="right"))
    last = sizes.column("order")[fits - 1].as_py() if fits else None
    found = rows.filter(F.col("order") <= F.lit(last)).orderBy("id").select("y", "terms").toArrow()
    scratch.drop(rows)
    y = found.column("y").to_numpy()
    if len(y) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32), y
    lists = found.column("terms").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten().to_numpy(), y


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, b`` of the logistic curve of ``a * margin + b`` (Platt, 1999), by Newton steps."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(margins).mean())) if len(margins) else 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - goal) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])
