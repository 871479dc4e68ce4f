"""SimHash near-duplicates, found by pigeonring filtering.

Two 64-bit fingerprints within ``BUDGET`` differing bits, cut into a ring of
``SEGMENTS`` consecutive segments, have a segment from which every chain of ``l``
segments differs in at most ``floor(l * BUDGET / SEGMENTS)`` bits (Qin and Xiao,
PVLDB 2018). The first two links of such a chain are an equi-join: the first
segment is equal and the second differs in one bit at most, so one side is indexed
by both segments as they are and the other is probed with every one-bit variant.
The longer chains and the full distance are checked on what the join proposes.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; a very long text counts all its shingles, some at a time. Rows keep their own result: repeated rows give repeated rows. A null
``doc_id`` never becomes a component id unless its component has no other. Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm import overlap
from treeq.llm.common import Scratch, bounded, components, documents, fresh, tidy

BUDGET = 4
WIDTHS = (13, 13, 13, 13, 12)
SEED = 42
#: Fingerprints with one join key from which on they are linked as stars.
CROWD = 1000
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned fingerprint of one whole text over ``width``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and spaces
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(join(words[i : i + width]), SEED) for i in range(at, min(n, at + BLOCK))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id``, the signed 64-bit ``fp`` and the ``key`` of every row."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, width) for t in batch], dtype=np.uint64).view(np.int64))
            tidy()

    return docs.select("doc_id", fp(docs["text"].cast("string")).alias("fp"), key_of(docs).alias("key"))


def key_of(docs: DataFrame) -> Column:
    """The id and a hash of the text, as one string."""
    hashed = F.hex(F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    return F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(" "), hashed)


def links(distinct: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` that join every two distinct ``fp`` within the budget.

    Keys with over ``crowd`` fingerprints are not joined pair by pair. Two
    fingerprints are within four bits exactly if some value is within two bits of
    both, so their members are grouped by each such value, and each group, all of
    whose members are within four bits of each other, is linked as a star.
    """
    starts = np.cumsum((0, *WIDTHS)).tolist()
    k = len(WIDTHS)

    def segment(i: int):
        return F.shiftrightunsigned("fp", starts[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))

    def key(i: int, second):
        return F.lit(i << 40).bitwiseOR(F.shiftleft(segment(i), 20)).bitwiseOR(second)

    index = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*[key(i, segment((i + 1) % k)) for i in range(k)])).alias("key"))
    variants = [
        key(i, segment((i + 1) % k).bitwiseXOR(F.lit(flip)))
        for i in range(k)
        for flip in (0, *[1 << bit for bit in range(WIDTHS[(i + 1) % k])])
    ]
    probe = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*variants)).alias("key"))

    masks = [((1 << WIDTHS[i]) - 1) << starts[i] for i in range(k)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    chains = [[signed(sum(masks[(i + j) % k] for j in range(length))) for i in range(k)] for length in range(1, k + 1)]
    differ = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("probe.key", 40).cast("int")
    near = F.col("a") < F.col("b")
    for length, per_start in enumerate(chains, 1):
        mask = F.get(F.array(*[F.lit(m) for m in per_start]), start)
        near &= F.bit_count(differ.bitwiseAND(mask)) <= length * BUDGET // k
    crowded = scratch.save(index.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    if not crowded.isEmpty():
        # a fingerprint that only asks for a crowded key may have none of its own
        asking = probe.select(F.col("a").alias("b"), "key")
        members = index.select("b", "key").union(asking).join(crowded, "key", "left_semi").select("b").distinct()
        index, probe = index.join(crowded, "key", "left_anti"), probe.join(crowded, "key", "left_anti")
    pairs = probe.alias("probe").join(index.alias("index"), (F.col("probe.key") == F.col("index.key")) & near).select("a", "b")
    return pairs if crowded.isEmpty() else pairs.union(stars(members))


def stars(members: DataFrame) -> DataFrame:
    """Star links over all members ``b`` that lie within two bits of one value."""
    flips = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i in range(64) for j in range(i)]]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flips]

    @F.pandas_udf("array<long>")
    def around(values: pd.Series) -> pd.Series:
        near = values.to_numpy()[:, None] ^ np.array(signed, dtype=np.int64)[None, :]
        return pd.Series(list(near))

    spread = members.repartition("b").select("b", F.explode(around("b")).alias("near"))
    hubs = spread.groupBy("near").agg(F.min("b").alias("hub"))
    return spread.join(hubs, "near").filter("b != hub").select(F.col("hub").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp, key, component_id, root`` of every row; ``root`` tells components apart."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs, width), "rows")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs = scratch.save(links(distinct, scratch), "links")
    roots = components(pairs, scratch)
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        distinct["fp"].alias("fp_key"), "least", F.coalesce("root", distinct["fp"]).alias("root")
    )
    labelled = scratch.save(labelled, "labelled")
    least = scratch.save(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = scratch.save(labelled.join(least, "root").select("fp_key", "component_id", "root"), "named")
    for done in (distinct, pairs, labelled, least):
        scratch.drop(done)
    return rows.join(named, F.col("fp") == F.col("fp_key")).select("doc_id", "fp", "key", "component_id", "root")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, alike: bool = False) -> DataFrame:
    """One row of ``docs`` for each component: that of its least id and then text hash.

    With ``alike``, texts of which ``overlap.LEAST`` of the five-word shingles are common
    are linked, too, however far their fingerprints are apart. Of equal rows any one
    stays; only such rows are grouped, all others are read where they lie.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    named = scratch.save(near_duplicates(docs).select("doc_id", "key", "root"), "named")
    if alike:
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), key_of(docs).alias("key"))
        grouped = texts.join(named.select("key", F.col("root").alias("group")).distinct(), "key")
        wider = components(overlap.groups_linked(grouped, scratch), scratch).withColumnRenamed("root", "whole")
        named = named.join(wider, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("whole", "root"))
    (key,) = fresh(docs, "key")
    each = named.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n"))
    kept = scratch.save(each.groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias(key), "first.n"), "kept")
    rows = docs.withColumn(key, key_of(docs))
    once = rows.join(bounded(kept.filter("n = 1").select(key)), key, "left_semi")
    several = rows.join(bounded(kept.filter("n > 1").select(key)), key, "left_semi").dropDuplicates([key])
    return once.unionByName(several).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(near_duplicates(documents(spark, sf_dir)))
