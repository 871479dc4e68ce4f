"""Hard negatives by blocked matrix products.

Anchors are broadcast in blocks of bounded size and multiplied with blocks of the
candidates, in float64, where the integers that components are rounded to stay exact
below 2^53. Two passes over the candidates for each block of anchors: the first keeps
each anchor's best candidates of its own label in every task, and merges what the tasks
kept; the second keeps, for each anchor and positive, the best candidates of other labels
whose score lies in the positive's window. A task holds one block of products and the
kept rows at a time, so no product matrix is ever written.

Products whose bound reaches 2^53 are computed as Python integers instead, and
scores outside of 64 bits are held at the ends of that range.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; an empty vector does, with the product 0. Products are of vectors
of one length: an anchor's candidates are the rows of its own length. Equal scores go
by smaller id. Every row is a candidate of its own, so repeated rows fill ranks of their own;
rows with the anchor's id are none of its candidates. Of repeated anchor rows one counts, the one
with the smallest label, then vector. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeq.llm.common import Scratch, before, documents, ordered

#: Rows and bytes of a block of anchors that is broadcast.
ANCHORS, ANCHOR_BYTES = 8192, 8 << 20
#: Anchors and candidates that are multiplied at once; a task's first blocks are smaller, until it knows what to keep.
ROWS, COLUMNS, FIRST = 512, 2048, 64
#: Below it, float64 holds every integer.
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` exactly: float64 if no partial sum can reach 2^53, else 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    # rows of moderate size stay with the fast product
    out = np.empty((len(a), len(b)), dtype=np.int64)
    limit = np.sqrt(EXACT / a.shape[1]) * 0.999
    small_a, small_b = (np.abs(x).max(axis=1) < limit for x in (a, b))
    out[np.ix_(small_a, small_b)] = (a[small_a] @ b[small_b].T).astype(np.int64)
    for rows, cols in ((~small_a, np.ones(len(b), dtype=bool)), (small_a, ~small_b)):
        if rows.any() and cols.any():
            whole = [[int(x) for x in row] for row in b[cols]]
            for i in np.flatnonzero(rows):
                own = [int(x) for x in a[i]]
                out[i, cols] = [min(MOST, max(LEAST, sum(map(int.__mul__, own, x)))) for x in whole]
    return out


class Best:
    """The ``k`` largest scores of each group seen so far, ties to smaller ids; lists of different tasks merge the same way."""

    def __init__(self, groups: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.int64)  # a group's lowest score that can still enter
        self.group, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.groups = groups

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate([x, y.astype(np.int64)]) for x, y in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, group))  # unlike -x, ~x has no overflow
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        stays = rank < self.k
        last = rank == self.k - 1
        self.least[group[last]] = score[last]
        self.group, self.score, self.id = group[stays], score[stays], ids[stays]


def scanner(block, positives: int, negatives: int, scale: float, windows: bool):
    """What turns candidate rows into the rows that a task keeps for one block of anchors.

    ``block.value`` has, for each length of vectors, ids, labels and the matrix of the
    anchors, and the ends of the windows of their positives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], Best] = {}
        steps: dict[tuple[int, int], int] = {}
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy()
            sizes, flat = np.diff(offsets), batch.column(2).values
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim, anchors in block.value.items():
                here = np.flatnonzero(sizes == dim)
                if not len(here):
                    continue
                x = flat.to_numpy(zero_copy_only=False)
                x = x[offsets[here][:, None] + np.arange(dim)] if len(here) < len(sizes) else x[offsets[0] : offsets[-1]].reshape(-1, dim)
                x = np.floor(x * scale)
                for lo in range(0, len(anchors["ids"]), ROWS):
                    own = slice(lo, lo + ROWS)
                    key = dim, lo
                    if key not in kept:
                        low = anchors["low"][own].ravel() if windows else np.full(len(anchors["ids"][own]), LEAST)
                        kept[key], steps[key] = Best(len(low), negatives if windows else positives, low), FIRST
                    at = 0
                    while at < len(here):
                        part = here[at : at + steps[key]]
                        met(kept[key], {k: v[own] for k, v in anchors.items()}, ids[part], labels[part], x[at : at + steps[key]])
                        at += steps[key]
                        steps[key] = min(COLUMNS, 2 * steps[key])
        for (dim, lo), best in kept.items():
            anchor, turn = np.divmod(best.group, positives) if windows else (best.group, np.zeros_like(best.group))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.value[dim]["ids"][lo + anchor]), pa.array(turn), pa.array(best.id), pa.array(best.score)],
                ["anchor_id", "turn", "vec_id", "score"],
            )

    def met(best: Best, anchors: dict, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        scores = products(anchors["matrix"], x)
        alike = anchors["labels"][:, None] == labels[None, :]
        if not windows:
            row, col = np.nonzero(alike & (scores >= best.least[:, None]))
            other = anchors["ids"][row] != ids[col]
            row, col = row[other], col[other]
            best.add(row, scores[row, col], ids[col])
            return
        least = best.least.reshape(-1, positives)
        found = []
        for j in range(positives):
            row, col = np.nonzero((scores <= anchors["high"][:, j, None]) & (scores >= least[:, j, None]) & ~alike)
            other = anchors["ids"][row] != ids[col]
            row, col = row[other], col[other]
            found.append((row * positives + j, scores[row, col], ids[col]))
        best.add(*map(np.concatenate, zip(*found)))

    return run


KEPT = "anchor_id long, turn long, vec_id long, score long"


def valid(vectors: DataFrame, label: Column, of: Column | None = None) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, ``v`` as doubles."""
    v = (F.col("embedding") if of is None else of).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, v``, none null, as ``valid`` gives them. Components count as
    ``floor(scale * x)``. A negative's score is at most the positive's, and at least ``percent`` hundredths of it.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "hardneg")
    rows = scratch.save(rows.select("vec_id", "label", "v"), "rows")
    one = F.min(F.struct("label", "v"))
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(one.alias("x")).select("vec_id", "x.label", "x.v", F.size("x.v").alias("dim"))
    anchors = ordered(anchors, ["dim", "vec_id"], scratch, "anchors")
    widest = anchors.agg(F.max("dim"), F.count("*")).first()
    schema = "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long"
    if not widest[1]:
        return spark.createDataFrame([], schema)
    each = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(1, widest[0]))))
    numbered = before(anchors, {"n": F.lit(1)}, ["dim", "vec_id"])
    numbered = scratch.save(numbered.withColumn("block", F.floor(F.col("n") / each)), "blocks")
    made: dict[str, list[str]] = {"positives": [], "negatives": []}

    def top(block, windows: bool) -> DataFrame:
        k, keys = (negatives, ["anchor_id", "turn"]) if windows else (positives, ["anchor_id"])
        found = rows.mapInArrow(scanner(block, positives, negatives, scale, windows), KEPT)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        name = "negatives" if windows else "positives"
        made[name].append(scratch.path(name))
        found.withColumn("rank", rank).filter(F.col("rank") <= k).write.parquet(made[name][-1])
        return spark.read.schema(f"{KEPT}, rank int").parquet(made[name][-1])

    for b in range(-(-widest[1] // each)):
        held = numbered.filter(F.col("block") == b).select("vec_id", "label", "v", "dim").toArrow()  # ``each`` anchors
        groups = by_dim(held, scale)
        sent = spark.sparkContext.broadcast(groups)
        best = top(sent, False).select("anchor_id", "rank", "score").toArrow()  # ``positives`` for each of them
        with_windows(groups, best, positives, percent)
        again = spark.sparkContext.broadcast(groups)
        top(again, True)
        sent.unpersist()
        again.unpersist()
    read = lambda name: spark.read.schema(f"{KEPT}, rank int").parquet(*made[name])
    left = read("positives").select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    right = read("negatives").select("anchor_id", (F.col("turn") + 1).cast("int").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return left.join(right, ["anchor_id", "positive_rank"]).select(*[x.split()[0] for x in schema.split(", ")])


def by_dim(held: pa.Table, scale: float) -> dict[int, dict[str, np.ndarray]]:
    """Ids, labels and matrix of a block's anchors, by the length of their vectors."""
    dims = held.column("dim").to_numpy()
    lists = held.column("v").to_pylist()
    found = {}
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        found[dim] = {
            "ids": held.column("vec_id").to_numpy()[own],
            "labels": held.column("label").to_numpy()[own],
            "matrix": np.floor(np.array([lists[i] for i in own], dtype=np.float64).reshape(len(own), dim) * scale),
        }
    return found


def with_windows(groups: dict[int, dict[str, np.ndarray]], best: pa.Table, positives: int, percent: int) -> None:
    """Adds the lowest and highest score that each positive lets in; none where an anchor has no such positive."""
    columns = [best.column(n).to_pylist() for n in ("anchor_id", "rank", "score")]
    scores = {(a, r): s for a, r, s in zip(*columns)}
    for own in groups.values():
        ids = own["ids"].tolist()
        high = [[scores.get((a, r + 1)) for r in range(positives)] for a in ids]
        low = [[MOST if s is None else max(LEAST, -(-percent * s // 100)) for s in row] for row in high]
        own["high"] = np.array([[LEAST if s is None else s for s in row] for row in high], dtype=np.int64).reshape(-1, positives)
        own["low"] = np.array(low, dtype=np.int64).reshape(-1, positives)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(valid(documents(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
  FROM s WHERE own = label QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, positive_rank,
       row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND own <> label AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
