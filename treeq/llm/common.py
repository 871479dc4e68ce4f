"""What the corpus operators share: components, bounds, folds; lineage cuts and order from the library.

Every helper keeps bulk data on the executors. What reaches the driver is one
number or one row per partition, never rows in proportion to the corpus.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.lineage import Scratch, before, ordered

__all__ = ["BROADCAST_ROWS", "WORD", "Scratch", "before", "bounded", "components", "documents", "fold", "fresh", "ordered", "tidy"]

#: A word, wherever a contract counts words: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast. A row here is a few hundred bytes at most, so
#: this proves a bound of some tens of MB.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay under ``limit``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tidy() -> None:
    """Gives memory that a Python worker no longer uses back to the machine.

    Workers live on between stages beside the executor's heap, so what they keep
    counts against the executor.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, roots included.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014). Each
    step keeps the number of edges at most equal, so no group is ever expanded into
    its pairs, and hubs only meet in joins that the adaptive planner may split.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(e.select(F.col("b"), F.col("a"))) if large else both.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        else:
            # the node itself and every smaller neighbour hang on the smallest one
            out = joined.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        made = scratch.save(out.filter("a != b").distinct(), "edges")
        scratch.drop(least)
        return made

    def mark(e: DataFrame):
        return e.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = scratch.save(edges.filter("a != b").select("a", "b").distinct(), "edges")
    seen = mark(now)
    while True:
        grown = star(now, True)
        small = star(grown, False)
        scratch.drop(grown)
        scratch.drop(now)
        now, last, seen = small, seen, mark(small)
        if seen == last:
            break
    # a settled forest: every edge leads from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
