"""Near copies by the share of shingles in common, found by prefix filtering.

A text is the set of its hashed ``WIDTH``-word shingles. If two sets share ``LEAST``
of their union, then in any one order of all shingles, their first ``n - ceil(LEAST *
n) + 1`` have one in common (Chaudhuri, Ganti and Kaushik, ICDE 2006). So an equi-join
on these proposes every such pair, and whole sets verify it. Shingles that are
frequent in a sample come last in the order; the sample only makes lists short and
decides nothing about the pairs found.

Only pairs of different groups are sought: a shingle whose texts all are in one group
is left out before the join. Blank texts have no shingles and no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeq.llm.common import Scratch, tidy

WIDTH = 5
LEAST = 0.8
#: One text in so many is looked at for frequent shingles, of which so many are put last.
SAMPLED = 16
FREQUENT = 100_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of one whole text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = (digest(join(words[i : i + width])) for i in range(max(1, len(words) - width + 1)))
    return np.unique(np.fromiter(hashes, dtype=np.uint64).view(np.int64))


def groups_linked(texts: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """Distinct ``(a, b)`` of groups that hold a pair of texts alike to ``least``.

    ``texts`` has ``text`` and its ``group``, a long; equal texts are of one group.
    """

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t) for t in batch])
            tidy()

    once = texts.select(F.xxhash64("text").alias("id"), "group", hashed("text").alias("set")).filter(F.size("set") > 0)
    sets = scratch.save(once.dropDuplicates(["id"]), "sets")
    sample = sets.filter(F.pmod("id", F.lit(SAMPLED)) == 0).select(F.explode("set").alias("shingle"))
    often = sample.groupBy("shingle").count().filter("count > 1").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    common, counts = (often.column(c).to_numpy().astype(np.int64) for c in ("shingle", "count"))
    by = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[by], counts[by]))  # FREQUENT rows at most

    @F.pandas_udf("array<long>")
    def prefix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, times = shared.value
        for batch in batches:
            out = []
            for x in batch:
                x = np.asarray(x, dtype=np.int64)
                seen = np.zeros(len(x), dtype=np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    seen = np.where(keys[at] == x, times[at], 0)
                out.append(x[np.lexsort((x, seen))][: len(x) - math.ceil(least * len(x) - 1e-9) + 1])
            yield pd.Series(out)
            tidy()

    heads = sets.select("id", "group", F.size("set").alias("n"), F.explode(prefix("set")).alias("shingle"))
    heads = scratch.save(heads, "heads")
    split = heads.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    heads = scratch.save(heads.join(split.select("shingle"), "shingle", "left_semi"), "split")
    a, b = heads.alias("a"), heads.alias("b")
    near = (F.col("a.group") < F.col("b.group")) & (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n") - 1e-9)
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & near).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    pairs = scratch.save(pairs.distinct(), "pairs")
    left = sets.select(F.col("id").alias("x"), F.col("group").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("y"), F.col("group").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9
    return scratch.save(pairs.join(left, "x").join(right, "y").filter(alike).select("a", "b").distinct(), "alike")
