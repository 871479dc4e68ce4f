"""Approximate nearest neighbours: lists, rotated vectors, adaptive dimension scan.

Vectors are scaled to length one and turned by a seeded random rotation, which
spreads every difference evenly over the dimensions. They lie in lists around
centroids that k-means finds on a bounded sample; every vector is in a list. How many
lists a query probes follows from the recall measured on that sample, early abandoning
included. Within each list that it probes, candidates lie column block by column block
(as in PDX, SIGMOD 2025). After each block, the distance so far, scaled up to all
dimensions, is tested against the query's present threshold: a candidate whose distance
is larger with high confidence is abandoned (ADSampling, SIGMOD 2023). While many pairs
of queries and candidates are left, a block is one matrix product; then only the pairs
left are looked at. What survives gets its exact cosine from the original vectors.

Equal vectors are one candidate with the smallest of their ids, as many as could be
returned, and one query; so a vector that a third of all rows share is scanned once.
Lists are cut into cells of bounded size. A task holds one cell at a time, and the
queries that probe it stream by; a cell is only copied for every ``QUERIES`` of them.

Defined cases: vectors that are null, zero, of another length than most, or with a
null or non-finite component take no part, nor do null ids. Equal scores go by
smaller id. A query with fewer candidates than ``k`` gets all those found. Repeated
rows of a query give its neighbours once. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.llm.common import Scratch, documents

#: Vectors that the centroids are fitted on at most, and numbers in them.
SAMPLE, SAMPLE_NUMBERS = 65_536, 1 << 22
MAX_LISTS = 4096
#: Part of the true neighbours that lie in the probed lists, as measured on ``TRIALS``
#: vectors of the sample, and how many lists a query probes at least.
RECALL, TRIALS, PROBED_AT_LEAST = 0.98, 500, 8
BLOCK = 16
#: Standard errors by which a scaled partial distance must exceed the threshold.
CONFIDENCE = 2.1
CELL, QUERIES = 4096, 1 << 16
#: Queries and candidates that are compared at once, and the part of their pairs from which on each is looked at.
TOGETHER, PORTION, FEW = 512, 1024, 1 / 8
#: Rounding of distances between unit vectors.
SLACK = 1e-12


@lru_cache(maxsize=1)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(2).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors by powers of two, so that their squares stay numbers; cosines keep every bit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        c = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], c)
    return c


def probes_for(recall: float, tried: np.ndarray, x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Lists that ``tried`` vectors must probe to find ``recall`` of their ``k`` nearest in ``x``.

    Neighbours that the scan of their list abandons count as found nowhere. Neighbours
    among all vectors are nearer than those in a sample, so they need no more lists.
    Vectors in clusters need a few lists, evenly spread ones most of them.
    """
    if not len(tried):
        return 1
    own = np.argmax(x @ c.T, axis=1)
    nearest, turns = [], []
    for q in np.array_split(tried, max(1, len(tried) // 50)):
        nearest.append(np.argsort(-(q @ x.T), axis=1)[:, :k])
        turn = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1).astype(float)
        turns.append(np.take_along_axis(turn, own[nearest[-1]], axis=1))
    nearest, turns = np.concatenate(nearest), np.concatenate(turns)
    turned = rotation(x.shape[1])
    spun, rotated = tried @ turned, x @ turned
    for i in np.unique(own[nearest]):
        members, asking = np.flatnonzero(own == i), np.flatnonzero((own[nearest] == i).any(axis=1))
        rows, cols = scan(spun[asking], blocked(rotated[members]), k + 1)
        found = set(zip(asking[rows].tolist(), members[cols].tolist()))
        for q in asking:
            for j in np.flatnonzero(own[nearest[q]] == i):
                if (int(q), int(nearest[q, j])) not in found:
                    turns[q, j] = np.inf
    least = np.quantile(turns.ravel(), recall, method="higher")
    return int(least) + 1 if np.isfinite(least) else len(c)


def blocked(x: np.ndarray) -> list[np.ndarray]:
    """Vectors as blocks of ``BLOCK`` dimensions, one row for a dimension."""
    return [np.ascontiguousarray(x[:, i : i + BLOCK].T) for i in range(0, x.shape[1], BLOCK)]


def scan(queries: np.ndarray, blocks: list[np.ndarray], k: int, first: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a candidate that may be among its ``k`` nearest in one cell.

    ``blocks`` hold the rotated candidates. They go in portions; the first sets the
    thresholds, and each one after it lowers them.
    """
    m, n, dim = len(queries), blocks[0].shape[1], queries.shape[1]
    own = [queries[:, i : i + BLOCK] for i in range(0, dim, BLOCK)]
    best = np.full((m, k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < n:
        hi = min(n, lo + (first if lo == 0 else PORTION))
        limit, whole, seen = best[:, k - 1] + SLACK, np.zeros((m, hi - lo)), 0
        pairs = None
        for q, b in zip(own, blocks):
            b = b[:, lo:hi]
            if pairs is None:
                whole += (b * b).sum(axis=0) + (q * q).sum(axis=1)[:, None] - 2 * (q @ b)
            else:
                d = b.T[pairs[1]] - q[pairs[0]]
                part += np.einsum("ij,ij->i", d, d)
            seen += len(b)
            if seen == dim:
                break
            # the hypothesis that the whole distance is within the limit
            bound = limit * (1 + CONFIDENCE / np.sqrt(seen)) ** 2 * (seen / dim)
            if pairs is None:
                stays = whole <= bound[:, None]
                if stays.mean() < FEW:
                    pairs = np.nonzero(stays)
                    part = whole[pairs]
                else:
                    whole[~stays] = np.inf
            else:
                stays = part <= bound[pairs[0]]
                pairs, part = (pairs[0][stays], pairs[1][stays]), part[stays]
        if pairs is not None:
            whole = np.full((m, hi - lo), np.inf)
            whole[pairs] = part
        best = np.sort(np.partition(np.concatenate([best, whole], axis=1), k - 1, axis=1)[:, :k], axis=1)
        rows, cols = np.nonzero(whole <= np.minimum(best[:, k - 1] + SLACK, np.finfo(float).max)[:, None])
        found.append((rows, cols + lo, whole[rows, cols]))
        lo = hi
    rows, cols, far = (np.concatenate(x) for x in zip(*found))
    stays = far <= best[rows, k - 1] + SLACK
    return rows[stays], cols[stays]


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of rows that take part, ``v`` as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(finite).filter(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common["n"] if common else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each query."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.save(valid(vectors).withColumns({"h": F.xxhash64("v"), "g": F.hash("v")}), "valid")
    # of equal vectors, only the k + 1 smallest ids can be returned to a query
    least = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    few = rows.select("vec_id", "h", "g").distinct().withColumn("n", least).filter(F.col("n") <= k + 1)
    ids = few.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = scratch.save(rows.groupBy("h", "g").agg(F.first("v").alias("v")).join(ids, ["h", "g"]), "distinct")
    asked = scratch.save(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "h", "g").distinct(), "asked")
    asked_vectors = distinct.join(asked.select("h", "g").distinct(), ["h", "g"], "left_semi")

    n = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    dim = distinct.select(F.size("v")).first()[0]
    fitted = distinct.orderBy("h", "g").limit(max(k, min(SAMPLE, SAMPLE_NUMBERS // dim))).select("v").toPandas()["v"]  # the sample
    sample = unit(np.stack(fitted.to_list()))
    lists = int(min(MAX_LISTS, max(1, round(np.sqrt(n) / 2)), len(sample)))
    trials = min(TRIALS, (len(sample) - lists) // 2)  # not fitted, so that they are like any other query
    fits = sample[trials:]
    found_centers = centroids(fits, lists)
    probes = min(lists, max(PROBED_AT_LEAST, probes_for(recall, sample[:trials], fits, found_centers, k)))
    center = spark.sparkContext.broadcast(found_centers)

    def listed(df: DataFrame, count: int) -> DataFrame:
        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            near = unit(np.stack(v.to_list())) @ center.value.T if len(v) else np.zeros((0, lists))
            return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :count].astype(np.int32)))

        return df.withColumn("list", F.explode(nearest("v")))

    base = scratch.save(listed(distinct, 1), "lists")
    probing = scratch.save(listed(asked_vectors.drop("ids"), probes), "probes")
    sizes = dict(base.groupBy("list").count().collect())  # MAX_LISTS rows
    loads = dict(probing.groupBy("list").count().collect())
    cells = F.array(*[F.lit(-(-sizes.get(i, 0) // CELL) or 1) for i in range(lists)])
    turns = F.array(*[F.lit(-(-loads.get(i, 0) // QUERIES) or 1) for i in range(lists)])
    many, several = F.get(cells, F.col("list")), F.get(turns, F.col("list"))
    spot = lambda count: F.pmod(F.xxhash64("h", "g"), count)
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))
    cell = ["list", "cell", "turn"]
    left = base.withColumn("cell", spot(many)).withColumn("turn", upto(several)).withColumn("asks", F.lit(0))
    right = probing.withColumn("turn", spot(several)).withColumn("cell", upto(many)).withColumns({"asks": F.lit(1), "ids": F.lit(None).cast("array<bigint>")})
    columns = [*cell, "asks", "h", "g", "v", "ids"]
    met = left.select(*columns).unionByName(right.select(*columns)).repartition(*cell).sortWithinPartitions(*cell, "asks")
    found = met.mapInArrow(scanner(dim, k), "h long, g int, score double, vec_id long")
    best = F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("score"), "vec_id"))
    found = scratch.save(found.withColumn("n", best).filter(F.col("n") <= k + 1), "found")
    lists_of = found.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))  # k + 1 each
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(scratch.save(lists_of, "near"), ["h", "g"])
        .select("query_id", F.posexplode(others).alias("pos", "x"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
    )


def scanner(dim: int, k: int):
    """What turns cells and the queries behind each into scored candidates, by ``k + 1`` a query."""

    def vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = rotation(dim)
        at, own, ready = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if at != (now := tuple(key[lo, :3])):
                    at, own, ready = now, [], None
                if key[lo, 3] == 0:
                    own.append((vectors(batch.column(6).slice(lo, hi - lo)), batch.column(7).slice(lo, hi - lo).to_pylist()))
                    continue
                if not own:
                    continue
                if ready is None:
                    x = scaled(np.concatenate([v for v, _ in own]))
                    every = [ids for _, part in own for ids in part]
                    ready = x, every, np.array([ids[0] for ids in every]), blocked(unit(x) @ turned), np.sqrt((x * x).sum(axis=1))
                for i in range(lo, hi, TOGETHER):
                    yield scored(batch.slice(i, min(hi, i + TOGETHER) - i), *ready)

    def scored(asked: pa.RecordBatch, x, every, least, blocks, norms) -> pa.RecordBatch:
        q = scaled(vectors(asked.column(6)))
        rows, cols = scan(unit(q) @ rotation(dim), blocks, k + 1)
        score = np.einsum("ij,ij->i", x[cols], q[rows]) / (norms[cols] * np.sqrt((q * q).sum(axis=1))[rows])
        order = np.lexsort((least[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.searchsorted(rows, rows)  # rows are sorted: places count from the first of a query
        near = np.arange(len(rows)) - first <= k
        rows, cols, score = rows[near], cols[near], score[near]
        ids = [every[c] for c in cols]
        n = [len(x) for x in ids]
        keys = [np.repeat(asked.column(c).to_numpy()[rows], n) for c in (4, 5)]
        flat = [i for x in ids for i in x]
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(np.repeat(score, n)), pa.array(flat, pa.int64())], ["h", "g", "score", "vec_id"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
